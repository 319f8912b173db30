"""Benchmark decontamination with a distributed positional inverted index.

Of each window of ten benchmark words the two rarest (by their count over all documents) are
anchors.  The index holds the postings (document, position) of the anchor terms.  Postings
shifted by the anchor's place in its item meet in (document, item, shift); a window can only
occur where both of its anchors do.  Those places are then compared word for word.  Everything
is DataFrame work; whole texts move once, next to the few places to look at.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.shared import bounded, settle

WIDTH = 10
ANCHORS = 2
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Digits, letters and everything beyond ASCII make words; only A-Z are lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms, length) of every item with a word; equal rows count once.
    A NULL item_id becomes the empty string."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("terms"))
    return rows.where(F.size("terms") > 0).distinct().select(
        F.xxhash64("item_id", "terms").alias("item"), "item_id", "terms", F.size("terms").alias("length"))


def _tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all documents, 0 for terms that none has."""
    seen = documents.select(F.explode(words(F.col("text"))).alias("term")).join(bounded(terms, BROADCAST_ROWS), "term", "left_semi")
    return terms.join(seen.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, width=WIDTH, per_window=ANCHORS) -> DataFrame:
    """(item, at, term): the places of an item that are among the rarest of a window."""
    placed = items.select("item", "length", F.posexplode("terms").alias("at", "term")).join(counts, "term")
    last = F.greatest(F.lit(0), F.col("length") - width)
    inside = placed.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), last))))
    by_rarity = Window.partitionBy("item", "start").orderBy("n", "at")
    return inside.withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= per_window).select("item", "at", "term").distinct()


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index: (term, doc_id, pos) of every occurrence of the terms."""
    return _tokens(documents).join(bounded(terms, BROADCAST_ROWS), "term", "left_semi").select("term", "doc_id", "pos")


def places(index: DataFrame, anchored: DataFrame, items: DataFrame, per_window=ANCHORS) -> DataFrame:
    """(doc_id, item, shift) where enough anchors of an item stand at the right distances."""
    lengths = items.select("item", F.least("length", F.lit(per_window)).alias("enough"))
    met = index.join(anchored.join(lengths, "item"), "term").select("doc_id", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", "enough")
    return met.groupBy("doc_id", "item", "shift").agg(F.count_distinct("at").alias("met"), F.max("enough").alias("enough")).where("met >= enough").drop("met", "enough")


def _hits(found: Column, width: int) -> Column:
    """Positions of a document inside exact windows of one item laid at one shift."""
    own = F.col("words")
    n = F.size(found["terms"])
    span = F.least(n, F.lit(width))
    # a sign per item word: does the document have it there
    signs = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
        F.try_element_at(own, F.when(found["shift"] + i >= 0, found["shift"] + i + 1).otherwise(F.size(own) + 1)) == found["terms"][i], "1").otherwise("0")), "")
    starts = F.filter(F.sequence(F.lit(0), n - span), lambda j: signs.substr(j + 1, span) == F.repeat(F.lit("1"), span))
    return F.flatten(F.transform(starts, lambda j: F.sequence(found["shift"] + j, found["shift"] + j + span - 1)))


def _nearest(documents: DataFrame, benchmark: DataFrame, width: int):
    items = settle(benchmark_items(benchmark))
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    anchored = settle(anchors(items, term_counts(documents, vocabulary), width))
    index = settle(postings(documents, anchored.select("term").distinct()))
    return items, anchored, index


def _judged(documents: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Every row whole (column whole), with n_words and hits: array of (item_id, at)."""
    items, anchored, index = _nearest(documents, benchmark, width)
    at = places(index, anchored, items).join(items.select("item", "item_id", "terms"), "item")
    looks = at.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "terms")).alias("looks")).withColumnRenamed("doc_id", "look_id")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"))
    met = rows.join(looks, F.col("whole.doc_id").eqNullSafe(F.col("look_id")), "left").select("whole", words(F.col("whole.text")).alias("words"), "looks")
    judged = met.select("whole", F.size(F.coalesce("words", F.array())).cast("long").alias("n_words"), F.transform(
        F.coalesce("looks", F.array().cast("array<struct<item_id:string,shift:int,terms:array<string>>>")),
        lambda x: F.struct(x["item_id"].alias("item_id"), _hits(x, width).alias("at"))).alias("hits"))
    return judged.withColumn("hits", F.filter("hits", lambda x: F.size(x["at"]) > 0))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    A word is hit if it lies inside any occurrence of a window of an item: width consecutive
    words, or the whole item if it is shorter.  NULL and wordless texts have no words and no
    hits; items without words have no window.  Rows with equal doc_id, NULL too, are judged
    each by its own text.  Other columns are not read."""
    named = _judged(documents.select("doc_id", "text"), benchmark, width).select(
        "whole.doc_id", "n_words", F.size(F.array_distinct(F.flatten("hits.at"))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct("hits.item_id")).alias("ids"))
    return named.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def near_matches(documents: DataFrame, benchmark: DataFrame, slop: int, width: int = WIDTH) -> DataFrame:
    """Proximity matches (doc_id, item_id, start, pos): all words of the item's window from
    start on occur, in any order, within slop words around the occurrence of its rarest word
    at pos, as far as the window would reach from there."""
    items, anchored, index = _nearest(documents, benchmark, width)
    met = index.join(anchored, "term").join(items, "item").select("doc_id", "item_id", "terms", "length", "at", "pos")
    looks = met.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "terms", "length", "at", "pos")).alias("looks")).withColumnRenamed("doc_id", "look_id")
    rows = documents.select("doc_id", "text").join(looks, F.col("doc_id").eqNullSafe(F.col("look_id"))).select(
        "doc_id", words(F.col("text")).alias("words"), F.explode("looks").alias("x"))
    last = F.greatest(F.lit(0), F.col("x.length") - width)
    rows = rows.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x.at") - width + 1), F.least(F.col("x.at"), last))))
    left = F.greatest(F.lit(0), F.col("x.pos") - F.col("x.at") + F.col("start") - slop)
    right = F.col("x.pos") - F.col("x.at") + F.col("start") + F.least(F.lit(width), F.col("x.length")) + slop
    window = F.slice("x.terms", F.col("start") + 1, F.lit(width))
    near = F.slice("words", left + 1, F.greatest(F.lit(0), right - left))
    return rows.where(F.size(F.array_except(window, near)) == 0).select("doc_id", "x.item_id", "start", "x.pos").distinct()


def without_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that hold a benchmark window, with all their columns; each
    row is judged by its own text."""
    # exploded, not filtered: a filter would be pushed below the words and split each text once per item word
    clean = F.when(F.size("hits") == 0, F.array("whole"))
    return _judged(documents, benchmark, width).select(F.explode(clean).alias("whole")).select("whole.*")
