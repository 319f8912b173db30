"""Reading scans, recogniser output and accounts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave import schemas
from scanweave.functions.fields import upload_error
from scanweave.operators.cheque import register_accounts

_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


def scan_images(spark: SparkSession, path, stream=False) -> DataFrame:
    """Uploaded files: path, length, mime (by suffix), content."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        # binaryFile has a fixed schema, but a stream wants it stated.
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*[F.lit(v) for kv in _MIME.items() for v in kv])
    return reader.load(path).select(
        "path", "length", F.coalesce(F.try_element_at(types, suffix), F.lit("")).alias("mime"), "content")


def with_intake_error(documents: DataFrame) -> DataFrame:
    return documents.withColumn("error", upload_error(F.col("length"), F.col("mime")))


def probe_images(spark: SparkSession, path) -> DataFrame:
    """Size per image file; ``decoded`` is false for a file Spark's image reader rejects.  The
    reader knows JPEG and PNG, not WebP."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return images.select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), (F.col("image.height") > 0).alias("decoded"))


def read_lines(spark: SparkSession, path, fmt="parquet", stream=False) -> DataFrame:
    """Flat recogniser lines; the stated schema prunes and never infers."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.OCR_LINES).format(fmt).load(path)


def recogniser_lines(raw: DataFrame, column="raw", keys=("doc_id", "read_id")) -> DataFrame:
    """Nested recogniser output, one JSON text per read, to lines with a quarantine column.  A
    detected line is ``[box, [text, score]]``, a line without detection ``[text, score]``; only
    the first page counts, and ``[null]`` is a page where nothing was read.  Lines come out
    trimmed and upper-cased like every recognised text.  ``fault`` is NULL for a good line; a
    record that is no JSON or no page has one row with its fault, a broken line is a row with
    its number and its fault."""
    records = raw.select(*keys, F.try_parse_json(F.col(column)).alias("_parsed")).withColumns({
        "_page": F.try_variant_get("_parsed", "$[0]", "array<variant>"),
        "_blank": F.coalesce(F.is_variant_null(F.try_variant_get("_parsed", "$[0]", "variant")), F.lit(False))})
    record_fault = F.when(F.col("_parsed").isNull(), F.lit("Not JSON.")).when(
        F.col("_page").isNull() & ~F.col("_blank"), F.lit("Not a page."))
    lines = records.select(*keys, record_fault.alias("record_fault"), F.posexplode_outer("_page").alias("line_no", "l"))
    lines = lines.where("l is not null or record_fault is not null")
    corners = F.try_variant_get(F.col("l"), "$[0]", "array<array<double>>")
    found = F.try_variant_get("l", "$[1][0]", "string").isNotNull() & corners.isNotNull()
    text = F.when(found, F.try_variant_get("l", "$[1][0]", "string")).when(corners.isNull(), F.try_variant_get("l", "$[0]", "string"))
    score = F.when(found, F.try_variant_get("l", "$[1][1]", "double")).otherwise(F.try_variant_get("l", "$[1]", "double"))
    box = F.transform(corners, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    fault = F.coalesce("record_fault", F.when(text.isNull() | score.isNull(), F.lit("Not a line.")))
    told = lines.select(*keys, "line_no", F.trim(F.upper(text)).alias("text"), score.alias("score"), F.when(found, box).alias("box"), fault.alias("fault"))
    return told.withColumns({c: F.when(F.col("fault").isNull(), F.col(c)) for c in ("text", "score", "box")})


def flatten_recogniser_json(raw: DataFrame, column="raw", keys=("doc_id", "read_id")) -> DataFrame:
    """The good lines of ``recogniser_lines``."""
    return recogniser_lines(raw, column, keys).where("fault is null").drop("fault")


def recognise(documents: DataFrame, recogniser, schema=schemas.OCR_LINES) -> DataFrame:
    """Hook for a caller's text recogniser: an iterator of pandas batches to an iterator of
    line batches, so that it can load its model once per task."""
    return documents.mapInPandas(recogniser, schema)


def read_accounts(spark: SparkSession, path, fmt="parquet", **options) -> DataFrame:
    """Account table from files, or from a database with fmt="jdbc" and its options."""
    reader = spark.read.format(fmt).options(**options)
    if fmt != "jdbc":
        reader = reader.schema(schemas.BANK_ACCOUNTS)
    return reader.load(path) if path else reader.load()


def load_accounts(accounts: DataFrame, path) -> DataFrame:
    """Settles an account table once, when it is loaded: the register goes to
    ``path/register``, rows that break its rules to ``path/quarantine``.  Returns the register."""
    register, quarantine = register_accounts(accounts)
    register.write.mode("overwrite").parquet(f"{path}/register")
    quarantine.write.mode("overwrite").parquet(f"{path}/quarantine")
    return accounts.sparkSession.read.parquet(f"{path}/register")


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """Numbers that break the uniqueness of the account table; empty when it is sound."""
    return accounts.groupBy("account_number").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
