"""Address field: a vote per line window, roll-up, fallback, known-name repair."""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.fuzzy import seq_ratio
from scanweave.functions.text import address_line, clean_generic, round4, tokens, vote_sum
from scanweave.operators.consensus import FEW, similarity_winners, text_buckets, winners_of_few
from scanweave.sources.shared import has_rows

PREPARED_BONUS = 0.03


def line_candidates(reads: DataFrame) -> DataFrame:
    """Reads of the line windows, cleaned; blank lines vanish, prepared crops count more."""
    bonus = F.when(F.col("variant") == "prepared", F.lit(PREPARED_BONUS)).otherwise(F.lit(0.0))
    # Exploding the text if there is one cleans once; a filter would clean again.
    clean = F.explode(F.filter(F.array(address_line(F.col("raw_text"))), lambda t: t != ""))
    return (
        reads.withColumn("clean_text", clean)
        .withColumn("raw_text", F.trim("raw_text"))
        .withColumn("confidence", F.col("confidence") + bonus)
    )


def line_winners(reads: DataFrame, key="doc_id") -> DataFrame:
    """Best text per document and line window.

    The reads of a window are few as a rule: they are brought together by document, unless they are
    already, and decided there.  Windows with more reads go by distinct texts and tiles; whether there
    are any is asked first.
    """
    group = [key, "line_idx"]

    def order(vote, text, best):
        short = F.size(F.filter(tokens(text), lambda w: F.length(w) <= 1))
        return F.struct(
            vote.alias("vote"), best["conf"].alias("conf"), (-short).alias("short"),
            F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("n"), best["neg"].alias("neg"))

    def of_few(some):
        return winners_of_few(text_buckets(line_candidates(some.repartition(key)), group), group, order)

    def of_many(some):
        buckets = text_buckets(line_candidates(some), group).select(*group, "clean_text", "conf_sum", "best")
        sized = buckets.withColumn("n_texts", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        return similarity_winners(sized, group, lambda vote: order(vote, F.col("clean_text"), F.col("best")))

    sizes = reads.groupBy(*group).agg(F.count(F.lit(1)).alias("n_reads"))
    crowded = sizes.where(F.col("n_reads") > FEW).select(*[F.col(c).alias(f"_{c}") for c in group])
    if not has_rows(crowded):
        return of_few(reads).select(*group, "r.*")
    here = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    rest, many = (reads.join(crowded, here, how) for how in ("left_anti", "left_semi"))
    return of_few(rest).unionByName(of_many(many)).select(*group, "r.*")


def roll_up_lines(winners: DataFrame, key="doc_id") -> DataFrame:
    """Lines of a document in window order; one row per window comes in, so few."""
    item = F.struct("line_idx", "raw_text", "clean_text")
    return winners.groupBy(key).agg(
        F.array_sort(F.collect_list(item)).alias("lines"),
        round4(vote_sum(F.col("confidence")) / F.count("confidence")).alias("confidence"),
    ).select(
        key,
        F.trim(F.array_join("lines.raw_text", " ")).alias("raw_text"),
        F.array_join("lines.clean_text", " ").alias("clean_text"),
        "confidence",
        F.col("lines.clean_text").alias("address_lines"),
    )


def fallback_read(lines: DataFrame, key="doc_id") -> DataFrame:
    """Best whole-crop read for documents without a usable line window.  ``lines``: OCR
    lines of the base and prepared crop, told apart by ``ordinal`` (0, 1)."""
    top = F.coalesce(F.array_min(F.col("box.y")), F.lit(0.0))
    left = F.coalesce(F.array_min(F.col("box.x")), F.lit(0.0))
    clean = F.col("clean_line")
    n = F.length(clean)
    shown = F.trim(F.upper("text"))
    item = F.struct(top.alias("top"), left.alias("left"), F.col("line_no"),
                    shown.alias("text"), clean.alias("clean"))
    reads = lines.withColumn("clean_line", address_line(F.trim(F.upper("text")))).groupBy(key, "ordinal").agg(
        F.count_if(n > 2).alias("long_lines"),
        F.sum(F.when(n > 2, n).otherwise(0)).alias("long_chars"),
        F.count_if((n > 0) & (n <= 2)).alias("short_lines"),
        round4(F.avg("score")).alias("confidence"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    rank = F.struct("long_lines", "long_chars", -F.col("short_lines"), "confidence", -F.col("ordinal"))
    best = reads.groupBy(key).agg(F.max_by(F.struct("items", "confidence"), rank).alias("w"))
    raw = F.array_join(F.filter(F.col("w.items.text"), lambda t: t != ""), " ")
    kept = F.filter(F.col("w.items.clean"), lambda t: t != "")
    return best.select(
        key, raw.alias("raw_text"),
        F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(clean_generic(raw)).alias("clean_text"),
        F.col("w.confidence").alias("confidence"), kept.alias("address_lines"),
    )


def address_vote(line_reads: DataFrame = None, fallback_lines: DataFrame = None, key="doc_id") -> DataFrame:
    """Address per document: line windows first, the whole-crop read where none is usable."""
    if line_reads is None:
        return fallback_read(fallback_lines, key)
    rolled = roll_up_lines(line_winners(line_reads, key), key)
    if fallback_lines is None:
        return rolled
    rest = fallback_lines.join(rolled.select(key), key, "left_anti")
    return rolled.unionByName(fallback_read(rest, key))


def repair_address(df: DataFrame, address="address", names=("father_name", "name")) -> DataFrame:
    """First line ``S/O someone``: a nearly equal known name replaces ``someone``; the full
    address is the lines again.  Documents without lines stay as they are."""
    first = F.get(F.col(f"{address}.line_items"), F.lit(0))
    relation = F.substring_index(first, " ", 1)
    is_relation = relation.isin(K.RELATION_PREFIXES) & F.contains(first, F.lit(" "))
    rest = F.when(is_relation, first.substr(F.length(relation) + 2, F.length(first)))
    known = [F.nullif(F.col(n), F.lit("")) for n in names]
    close = [F.when(seq_ratio(rest, n) >= K.KNOWN_NAME_MIN_RATIO, n) for n in known]
    fixed = F.concat(relation, F.lit(" "), F.coalesce(*close))
    repaired = df.withColumn("_fixed", fixed)
    old = F.col(f"{address}.line_items")
    lines = F.when(
        F.col("_fixed").isNotNull(), F.concat(F.array("_fixed"), F.slice(old, 2, F.greatest(F.size(old), F.lit(1))))
    ).otherwise(old)
    return repaired.withColumn("_lines", lines).withColumn(address, F.col(address).withField(
        "address_line_1", F.coalesce(F.col("_fixed"), F.col(f"{address}.address_line_1"))
    ).withField("line_items", F.col("_lines")).withField(
        "full_address",
        F.when(F.size("_lines") > 0, F.array_join("_lines", " ")).otherwise(F.col(f"{address}.full_address")),
    )).drop("_fixed", "_lines")
