"""URL filters: fixed rules, and empirical-Bayes reputation of hosts for the rest.

Labelled pages are outcomes of their host.  The mean of all is the prior of the suffixes, each
suffix's posterior of its registered domains, theirs of its hosts.  How strong a prior is, is
fitted by moments for each level: from the spread between the groups of one parent, less what
chance alone makes of it.  A url is blocked when the lower end of its host's posterior
rate of bad pages is beyond the limit.  Built-in functions only.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, domain, beginning of the path), fixed values
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: lower bound of the rate of bad pages from which a host is blocked, and the bound's deviations
LIMIT = 0.5
DEVIATIONS = 1.64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); NULL without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    fits = [F.when(((host == d) | F.endswith(host, F.lit("." + d))) & F.startswith(path, F.lit(p)), F.struct(F.lit(d + p).alias("rule"), F.lit(v).alias("verdict"))) for v, d, p in ordered]
    return F.coalesce(*fits)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def registered(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _prior(rates: DataFrame) -> DataFrame:
    """One row (mean, strength): beta prior by moments of the rates of all groups, at least
    1 and at most 100 strong; (0.5, 2) without any."""
    n = F.sum("n")
    mean = F.sum("bad") / n
    one = rates.agg(mean.alias("mean"), (F.sum(F.pow(F.col("bad") / F.col("n"), 2) * F.col("n")) / n).alias("square"))
    spread = F.col("square") - F.pow("mean", 2)
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.col("mean") * (1 - F.col("mean")) / spread - 1)))
    return one.select(F.coalesce("mean", F.lit(0.5)).alias("mean"), F.coalesce(strength, F.lit(2.0)).alias("strength"))


def _strength(groups: DataFrame, parent: str, name: str) -> DataFrame:
    """One row: how many outcomes the parent's rate is worth as the prior of its groups, the
    variance within groups over that between them (analysis of variance within the parents).
    At least 1 and at most 100, which it is where groups differ no more than by chance; 2 if no
    parent has two groups or no group two outcomes."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    one = groups.where("n > 0").groupBy(parent).agg(F.count("*").alias("k"), F.sum(n).alias("m"), F.sum(bad).alias("b"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("q"))
    one = one.agg(
        F.sum(F.col("k") - 1).alias("k"), F.try_divide(F.sum(F.col("b") - F.col("q")), F.sum(F.col("m") - F.col("k"))).alias("within"),
        F.sum(F.col("q") - F.col("b") * F.col("b") / F.col("m")).alias("square"), F.sum(F.col("m") - F.col("nn") / F.col("m")).alias("size"))
    between = F.try_divide(F.col("square") - F.col("k") * F.col("within"), F.when(F.col("k") > 0, F.col("size")))
    fitted = F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.try_divide(F.col("within"), between)))).when(between <= 0, F.lit(100.0))
    return one.select(F.coalesce(fitted, F.lit(2.0)).alias(name))


def reputation(outcomes: DataFrame, shared_strength: bool = False) -> DataFrame:
    """(host, bad_rate, bound) of every host from outcomes (host, bad), bad NULL for pages
    without a label.  Outcomes are summed before the shuffle, so one host may hold any share.
    With shared_strength the spread between suffixes alone sets the strength of all levels."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", registered(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    prior = _prior(tops.where("n > 0"))
    if shared_strength:
        prior = prior.select("mean", "strength", F.col("strength").alias("of_domains"), F.col("strength").alias("of_hosts"))
    else:
        prior = prior.select("mean")
        for level in (_strength(tops.withColumn("all", F.lit(0)), "all", "strength"), _strength(domains, "suffix", "of_domains"), _strength(hosts, "domain", "of_hosts")):
            prior = prior.join(F.broadcast(level), F.lit(True))  # one row

    def shrunk(name):
        return ((F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias(name)

    top = tops.join(F.broadcast(prior), F.lit(True)).select("suffix", shrunk("mean"), F.col("of_domains").alias("strength"), "of_hosts")  # one row
    middle = domains.join(top, "suffix").select("domain", shrunk("mean"), F.col("of_hosts").alias("strength"))
    a, b = F.col("bad") + F.col("strength") * F.col("mean"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("mean"))
    rate, deviation = a / (a + b), F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.join(middle, "domain").select("host", F.round(rate, 9).alias("bad_rate"), F.round(F.greatest(F.lit(0.0), rate - DEVIATIONS * deviation), 9).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, shared_strength: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound for every row.

    The label of a page is the quality of the labelled document with its number; 0 is a bad
    outcome.  Several labels of one page count as bad if any is.  NULL urls and urls without
    :// have the empty host and path; the empty host is judged like any other.  Rows with
    equal or NULL page_id are judged each by its own url.  Other columns are not read."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad")).withColumnRenamed("doc_id", "page_id")
    standing = reputation(parsed.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), shared_strength)
    found = parsed.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    return found.join(standing, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bound")
