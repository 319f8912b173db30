"""OCR lines to reads and document texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions.text import round4


def _first(box: Column, axis: str) -> Column:
    return F.coalesce(F.array_min(box[axis]), F.lit(0.0))


def assemble_reads(lines: DataFrame, keys=("doc_id", "read_id")) -> DataFrame:
    """One row per read: texts in (top, left) order, mean score of all its lines.  A line
    without a box sorts as (0, 0); equal positions keep the recogniser's order."""
    text = F.trim(F.upper("text"))
    item = F.struct(
        _first(F.col("box"), "y").alias("top"), _first(F.col("box"), "x").alias("left"),
        F.col("line_no"), text.alias("text"),
    )
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.when(text != "", item)))["text"], " "
        ).alias("raw_text"),
        round4(F.avg("score")).alias("confidence"),
        F.count(F.lit(1)).alias("line_count"),
    )


def with_expected_reads(reads: DataFrame, expected: DataFrame, keys=("doc_id", "read_id")) -> DataFrame:
    """Every expected read; one that recognised nothing is empty with confidence 0."""
    return expected.join(reads, list(keys), "left").fillna({"raw_text": "", "confidence": 0.0})


def document_text(lines: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Whole text of a document in the recogniser's own order, upper-cased."""
    item = F.struct(F.col("line_no"), F.upper(F.coalesce("text", F.lit(""))).alias("text"))
    return lines.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(item))["text"], " ").alias("text")
    )
