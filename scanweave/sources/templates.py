"""Region templates in JSON: a map of field to four fractions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave import constants as K

_MAP = "map<string,array<double>>"


def default_templates(spark: SparkSession, template_id="default") -> DataFrame:
    rows = [(template_id, f, *map(float, box)) for f, box in K.DEFAULT_ROIS.items()]
    return spark.createDataFrame(rows, "template_id string, field string, x1 double, y1 double, x2 double, y2 double")


def load_templates(spark: SparkSession, path) -> DataFrame:
    """One template per JSON file, the file name being its id, or per line of what
    ``save_templates`` wrote.  Files that do not parse yield nothing, and fields a template
    lacks come from the defaults."""
    texts = spark.read.option("wholetext", "true").text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1).alias("file"), "value")
    lines = texts.select("file", "value", F.explode(F.split("value", "\n")).alias("line")).select(
        "file", "value", F.from_json("line", f"template_id string, rois {_MAP}").alias("saved"))
    saved = lines.where("saved.template_id is not null and saved.rois is not null")
    bare = texts.join(saved.select("file").distinct(), "file", "left_anti")
    files = saved.select("saved.template_id", F.col("saved.rois").alias("m")).unionByName(
        bare.select(F.col("file").alias("template_id"), F.from_json("value", _MAP).alias("m")))
    stored = files.select("template_id", F.explode("m").alias("field", "b")).where("size(b) = 4").select(
        "template_id", "field", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    defaults = F.map_from_entries(F.array(*[
        F.struct(F.lit(f), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b)]))
        for f, b in K.DEFAULT_ROIS.items()]))
    every = files.select("template_id", F.explode(defaults).alias("field", "d"))
    return every.join(stored, ["template_id", "field"], "full_outer").select(
        "template_id", "field", *[F.coalesce(n, f"d.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])


def save_templates(templates: DataFrame, path) -> None:
    """JSON lines of (template_id, rois); a template has a handful of fields."""
    box = F.struct("field", F.array("x1", "y1", "x2", "y2").alias("b"))
    templates.groupBy("template_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(box))).alias("rois")
    ).write.mode("overwrite").json(path)
