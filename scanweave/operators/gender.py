"""Gender field: label positions to tick-box windows, scores to a gender."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.gender import merge_confidence, resolve_gender
from scanweave.functions.geometry import box_bounds, checkbox_window, fraction_to_pixels


def checkbox_windows(lines: DataFrame, key="doc_id", width="width", height="height") -> DataFrame:
    """Tick-box window per document and gender, in score order: detected labels first, in
    reading order, then the template's.  ``lines``: OCR lines of the gender crop with the
    crop's size.  A label seen twice counts where it was last seen."""
    labels = F.create_map(*[F.lit(v) for kv in K.GENDER_LABELS.items() for v in kv])
    top, left = F.array_min(F.col("box.y")), F.array_min(F.col("box.x"))
    at = F.struct(F.coalesce(top, F.lit(0.0)).alias("top"), F.coalesce(left, F.lit(0.0)).alias("left"), F.col("line_no"))
    seen = lines.select(
        key, width, height, at.alias("at"),
        F.try_element_at(labels, F.trim(F.upper("text"))).alias("label"),
        checkbox_window(box_bounds(F.col("box")), F.col(height)).alias("window"),
    )
    names = list(K.GENDER_WINDOWS)

    def hit(name):
        return F.when((F.col("label") == name) & F.col("window").isNotNull(), F.col("at"))

    wide = seen.groupBy(key).agg(
        F.max(width).alias("w"), F.max(height).alias("h"),
        *[F.max_by("window", hit(n)).alias(f"found_{n}") for n in names],
        *[F.min(hit(n)).alias(f"at_{n}") for n in names],
    )
    rows = []
    for i, n in enumerate(names):
        x1, y1, x2, y2 = K.GENDER_WINDOWS[n]
        default = fraction_to_pixels((x1, y1, x2, y2), F.col("w"), F.col("h"))
        rows.append(F.struct(
            F.col(f"at_{n}").isNull().alias("default"), F.col(f"at_{n}").alias("at"), F.lit(i).alias("i"),
            F.lit(n).alias("label"), F.coalesce(F.col(f"found_{n}"), default).alias("window"),
        ))
    ordered = wide.select(key, F.posexplode(F.array_sort(F.array(*rows))).alias("ordinal", "r"))
    return ordered.select(
        key, "ordinal", F.col("r.label").alias("label"), (~F.col("r.default")).alias("detected"),
        *[F.col(f"r.window.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")],
    )


def gender_scores(scores: DataFrame, key="doc_id") -> DataFrame:
    """Score rows (label, ordinal, score) to one ordered array of at most three entries."""
    labels = list(K.GENDER_WINDOWS)
    per_label = [
        F.max_by(F.struct(F.col("ordinal"), F.col("label"), F.col("score")),
                 F.when(F.col("label") == n, F.col("ordinal"))).alias(f"s_{i}")
        for i, n in enumerate(labels)
    ]
    wide = scores.groupBy(key).agg(*per_label)
    entries = F.array_sort(F.filter(F.array(*[f"s_{i}" for i in range(len(labels))]), lambda e: e.isNotNull()))
    return wide.select(key, F.transform(
        entries, lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"))).alias("scores"))


def gender_field(scores: DataFrame, reads: DataFrame = None, key="doc_id") -> DataFrame:
    """Gender per document with the larger of read and tick-box confidence."""
    joined = gender_scores(scores, key).withColumn("g", resolve_gender(F.col("scores")))
    if reads is not None:
        joined = joined.join(reads.select(key, "raw_text", F.col("confidence").alias("read_conf")), key, "left")
    else:
        joined = joined.withColumns({"raw_text": F.lit(None).cast("string"), "read_conf": F.lit(None).cast("double")})
    return joined.select(
        key, F.trim(F.coalesce("raw_text", F.lit(""))).alias("raw_text"), F.col("g.gender").alias("clean_text"),
        merge_confidence(F.coalesce("read_conf", F.lit(0.0)), F.col("g.confidence")).alias("confidence"),
    )
