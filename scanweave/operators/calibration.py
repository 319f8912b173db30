"""Region templates: defaults, merge, calibration events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.geometry import drag_box

EDGES = ("x1", "y1", "x2", "y2")


def merge_templates(templates: DataFrame, updates: DataFrame, keys=("template_id", "field")) -> DataFrame:
    """Updated fields replace stored ones, new ones are added, the rest is kept."""
    new = updates.select(*keys, *[F.col(e).alias(f"new_{e}") for e in EDGES])
    return templates.join(new, list(keys), "full_outer").select(
        *keys, *[F.coalesce(f"new_{e}", e).alias(e) for e in EDGES])


def calibrated_regions(events: DataFrame, keys=("template_id", "field")) -> DataFrame:
    """Last drawn box per field from drag events (x_from, y_from, x_to, y_to, ordinal)."""
    box = drag_box(F.col("x_from"), F.col("y_from"), F.col("x_to"), F.col("y_to"))
    return events.groupBy(*keys).agg(F.max_by(box, F.col("ordinal")).alias("b")).select(
        *keys, *[F.col(f"b.{e}").alias(e) for e in EDGES])
