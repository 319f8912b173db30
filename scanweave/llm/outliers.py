"""Quality rules and robust multivariate outliers.

Base statistics of every text, two fixed rules on them, and for the rest a minimum covariance
determinant estimate per language and source: concentration steps take, again and again, the
three quarters of a group's rows that lie nearest to its centre, and rows whose Mahalanobis
distance from the final centre is far beyond what the shape allows are rejected.

Quantiles come from counts of fixed bins and sums are exact decimals, so a group may hold any
share of the rows, is never gathered, and every run gives the same verdicts.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.shared import row_key, settle, slices, spare, words_of

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
SHARE = 0.75
#: of four normal features, the nearest 0.75 show 0.5046 / 0.75 of the variance: chi2 with 6 at the 0.75 quantile of chi2 with 4
SPREAD = 0.75 / 0.5046
STEPS = 4
LEAST_ROWS = 40
FEATURES = ("f0", "f1", "f2", "f3")
#: no spread is taken to be less than this, in the units of the features
FLOOR = (0.05, 0.05, 0.10, 0.08)
#: squared distance beyond which a row is rejected
LIMIT = 70.0
_UNIT = 1 << 20
_BINS = 64
_BLANKS = " \t\n\v\f\r"


def _triples(codes, words):
    """A number of 64 bits for each three codes in a row, equal for equal ones only."""
    wide = codes.astype(np.uint64)
    if len(wide) < 3:
        return wide[:0]
    if words <= 1 << 21:
        return (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    _, pair = np.unique((wide[:-1] << np.uint64(32)) | wide[1:], return_inverse=True)
    return (pair[:-1].astype(np.uint64) << np.uint64(32)) | wide[2:]


def _statistics(keys):
    def run(batches):
        for rows, texts in slices(batches):
            codes, starts, names = words_of(texts)
            length = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.empty(0, np.int64)
            total = np.concatenate([[0], np.cumsum(length[codes])]) if len(codes) else np.zeros(1, np.int64)
            repeated = []
            keyed = _triples(codes, len(names))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a < 4:
                    repeated.append(0)
                    continue
                _, at, count = np.unique(keyed[a : b - 2], return_inverse=True, return_counts=True)
                again = count[at] > 1
                inside = np.zeros(b - a, bool)
                for k in range(3):
                    inside[k : k + len(again)] |= again
                repeated.append(int(inside.sum()))
            doubled = []
            for text in texts.to_pylist():
                lines = text.split("\n")
                kept = [x for x in lines if x.strip(_BLANKS)] if len(lines) > 1 else lines[:0]
                doubled.append(len(kept) - len(set(kept)))
            symbols = pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64())
            arrays = [pa.array(np.diff(starts)), pa.array(total[starts[1:]] - total[starts[:-1]]), symbols, pa.array(doubled, pa.int64()), pa.array(repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), *arrays], [*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    return run


def statistics(documents: DataFrame, keys=("doc_id",)) -> DataFrame:
    """The key columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    return documents.select(*keys, "text").mapInArrow(
        _statistics(keys), f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def _featured(stats: DataFrame) -> DataFrame:
    """Whole numbers of 2**-20: log of the mean word length, and square roots of the shares
    of symbols, doubled lines and repeated words, all of them on a common scale of words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    # few words say little about their mean: shrink the mean word length of short texts to 5
    mean = (F.col("word_chars") + 5 * 20) / (n + 20)
    values = (F.log(mean), F.sqrt(F.col("n_symbols") / (n + 20)), F.sqrt(F.col("n_dup_lines") / (n / 20 + 5)), F.sqrt(F.col("n_repeat_words") / (n + 50)))
    return stats.withColumns({f: F.floor(v * _UNIT + 0.5).cast("long") for f, v in zip(FEATURES, values)})


def _median(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """(g, f, q): quantile per group and feature from counts of bins."""
    long = rows.select("g", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*FEATURES))).alias("f", "v"))
    bins = long.groupBy("g", "f", F.floor(F.col("v") / (_UNIT // 4096)).alias("bin")).count()
    w = Window.partitionBy("g", "f")
    reached = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    return reached.where(F.col("upto") >= share * F.col("all")).groupBy("g", "f").agg(F.min("bin").alias("bin")).select(
        "g", "f", ((F.col("bin") + 0.5) / 4096).alias("q"))


def _wide(medians: DataFrame, name: str) -> DataFrame:
    return medians.groupBy("g").agg(*[F.max(F.when(F.col("f") == f, F.col("q"))).alias(f"{name}{i}") for i, f in enumerate(FEATURES)])


def _squared():
    x = [F.col(f) / _UNIT - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    k = len(FEATURES)
    return F.greatest(sum((x[i] * x[j] * F.col("inv")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0)), F.lit(0.0))


def _distance(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the shape of the row's group."""
    return rows.join(shape, "g").withColumn("d2", _squared())


def _bin(d2):
    return F.floor(F.log2(d2 + 1e-6) * _BINS).cast("int")


def _cuts(measured: DataFrame) -> DataFrame:
    """(g, cut, middle): the bins of d2 that the nearest share of a group, and its nearer
    half, reach."""
    bins = measured.groupBy("g", _bin(F.col("d2")).alias("bin")).count()
    w = Window.partitionBy("g")
    reached = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    least = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin")))
    return reached.groupBy("g").agg(least(SHARE).alias("cut"), least(0.5).alias("middle"))


def _shapes(floor):
    """Centre and inverse covariance from the sums of each group."""
    k = len(FEATURES)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                n = float(r["n"])
                m = np.array([float(r[f"s{i}"]) for i in range(k)]) / n / _UNIT
                c = np.array([[float(r[f"p{min(i, j)}{max(i, j)}"]) for j in range(k)] for i in range(k)]) / n / _UNIT**2 - np.outer(m, m)
                inverse = np.linalg.inv(c * r["scale"] + np.diag(np.square(floor)))
                out.append({"g": r["g"], **{f"m{i}": m[i] for i in range(k)}, "inv": inverse.ravel().tolist()})
            yield pd.DataFrame(out, columns=["g", *(f"m{i}" for i in range(k)), "inv"])
    return run


_SHAPE = "g string, m0 double, m1 double, m2 double, m3 double, inv array<double>"


def _concentrate(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """One concentration step: the next shape from the nearest rows of each group.  Their
    spread is scaled up to that of a whole normal sample."""
    k = len(FEATURES)
    measured = _distance(rows, shape)
    cuts = settle(_cuts(measured))
    near = measured.join(cuts, "g").where(_bin(F.col("d2")) <= F.col("cut"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = near.groupBy("g").agg(
        F.count("*").alias("n"), *[exact(F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[exact(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in range(k) for j in range(i, k)])
    return settle(sums.withColumn("scale", F.lit(SPREAD)).mapInPandas(_shapes(FLOOR), _SHAPE))


def shapes(rows: DataFrame) -> DataFrame:
    """MCD estimate per group g, from coordinate medians and median deviations onwards."""
    middle = _wide(settle(_median(rows)), "m")
    off = rows.join(middle, "g").select("g", *[F.abs(F.col(f) - F.col(f"m{i}") * _UNIT).cast("long").alias(f) for i, f in enumerate(FEATURES)])
    spread = _wide(_median(off), "d")
    k = len(FEATURES)
    first = middle.join(spread, "g").select("g", *[f"m{i}" for i in range(k)], F.array(*[
        1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0) for i in range(k) for j in range(k)]).alias("inv"))
    shape = settle(first)
    for _ in range(STEPS):
        shape = _concentrate(rows, shape)
    return shape


def quality_rules(documents: DataFrame, keys=("doc_id",), limit: float = LIMIT) -> DataFrame:
    """The key columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, d2 and kept, one row per input row.

    NULL and wordless texts fail the base rules.  A NULL lang or source is a group of its own.
    Rows of a group with fewer than LEAST_ROWS rows that pass the base rules are judged by the
    shape of all such rows of their language, or of the table if these are too few as well.
    Only in a table with fewer than LEAST_ROWS are they kept and d2 is NULL.  Rows are judged one by one
    whatever their keys; other columns are not read."""
    lang = F.coalesce(F.col("lang"), F.lit("\\N"))
    named = documents.select(*keys, "text", lang.alias("_lang"), F.concat_ws("|", lang, F.coalesce(F.col("source"), F.lit("\\N"))).alias("_group"))
    stats = statistics(named, (*keys, "_lang", "_group"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(_featured(stats.withColumn("base_failed", failed)))
    counts = settle(rows.where("not base_failed").groupBy("_lang", "_group").count())
    of_lang = counts.groupBy("_lang").agg(F.sum("count").alias("lang_count"))
    of_all = counts.agg(F.sum("count").alias("all_count"))
    level = F.when(F.col("count") >= LEAST_ROWS, F.concat(F.lit("="), "_group")).when(F.col("lang_count") >= LEAST_ROWS, F.concat(F.lit("~"), "_lang")).when(F.col("all_count") >= LEAST_ROWS, F.lit("*"))
    levels = settle(counts.join(of_lang, "_lang").join(F.broadcast(of_all), F.lit(True)).select("_lang", "_group", level.alias("g")))  # of_all is one row
    grouped = settle(rows.join(levels, ["_lang", "_group"], "left").drop("_group"))
    fine = grouped.where("not base_failed and startswith(g, '=')").select("g", *FEATURES)
    wider = levels.where("g = '*' or startswith(g, '~')").select("g", F.when(F.col("g") != "*", F.col("_lang")).alias("_lang")).distinct()
    by_lang = grouped.where("not base_failed").select("_lang", *FEATURES).join(wider.where("_lang is not null"), "_lang").select("g", *FEATURES)
    by_all = grouped.where("not base_failed").select(*FEATURES).join(F.broadcast(wider.where("_lang is null").select("g")), F.lit(True)).select("g", *FEATURES)
    shape = shapes(fine.unionByName(by_lang).unionByName(by_all))
    judged = grouped.join(shape, "g", "left").withColumn("d2", F.when(~F.col("base_failed"), _squared()))
    return judged.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("d2", 6).alias("d2"),
                         (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"))


def without_outliers(documents: DataFrame) -> DataFrame:
    """The documents that are kept; rows are told apart by doc_id and text."""
    row = spare(documents, "_row")
    keyed = documents.withColumn(row, row_key())
    bad = quality_rules(keyed.select(row, "text", "lang", "source"), (row,)).where("not kept").select(row).distinct()
    return keyed.join(bad, row, "left_anti").drop(row)
