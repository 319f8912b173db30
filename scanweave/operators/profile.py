"""One nested profile per document from its field results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.address import parse_address
from scanweave.functions.fields import public_engine_fields
from scanweave.functions.text import let, review_flags
from scanweave.operators.address import repair_address

ADDRESS_KEYS = (
    "city", "district", "town_or_city", "address_line_1", "village", "street_or_post_office",
    "area_or_locality",
)


def assemble_profiles(results: DataFrame, key="doc_id") -> DataFrame:
    """``results``: one row per document and field with raw_text, clean_text, confidence and,
    for the address, address_lines.  The seven fields become columns in one aggregation."""
    value = F.struct(
        F.trim("raw_text").alias("raw_text"), "clean_text", F.col("confidence").cast("double").alias("confidence"),
        "address_lines",
    )
    wide = results.groupBy(key).agg(*[
        F.max(F.when(F.col("field") == f, value)).alias(f"f_{f}") for f in K.ENGINE_FIELDS])

    def text(f, default=""):
        return F.coalesce(F.col(f"f_{f}.clean_text"), F.lit(default))

    named = wide.select(
        "*",
        text("name").alias("name"), text("father_name").alias("father_name"),
        parse_address(text("address"), text("pin"), text("state"), F.col("f_address.address_lines")).alias("address"),
    )
    known = repair_address(named)

    def entries(make):
        present = F.array(*[
            F.when(F.col(f"f_{f}").isNotNull(), F.struct(F.lit(f).alias("key"), make(F.col(f"f_{f}")).alias("value")))
            for f in K.ENGINE_FIELDS])
        return F.map_from_entries(F.filter(present, lambda e: e.isNotNull()))

    return known.select(
        key,
        F.col("name").alias("full_name"),
        text("dob").alias("dob"),
        text("gender", "Male").alias("gender"),
        "father_name",
        F.struct(text("state").alias("state"), text("pin").alias("pincode"), F.lit("INDIA").alias("country")).alias("location"),
        F.struct(
            F.col("address.full_address").alias("raw_text"),
            *[F.col(f"address.{k}").alias(k) for k in ADDRESS_KEYS],
            F.col("address.line_items").alias("lines"),
        ).alias("address_details"),
        entries(lambda v: review_flags(v["confidence"])).alias("confidence_metrics"),
        entries(lambda v: v["raw_text"]).alias("raw_extracted_text"),
    )


def project_profile(profiles: DataFrame, fields, key="doc_id") -> DataFrame:
    """Requested output fields only.  A list of names selects columns, so that unused work is
    pruned; an array Column decides per row and leaves the rest NULL."""
    per_row = isinstance(fields, Column)
    wanted = fields if per_row else F.array(*[F.lit(f) for f in fields])
    public = public_engine_fields(wanted)
    # Metadata alone shows every field.
    every = F.array(*[F.lit(f) for f in K.ENGINE_FIELDS])

    def column(f):
        value = F.col(f)
        if f in K.METADATA_FIELDS:
            # Bound before the entries are gone through, else it would be worked out for each.
            value = let(public, lambda p: let(F.when(F.size(p) > 0, p).otherwise(every), lambda shown: F.map_filter(
                F.col(f), lambda k, _: F.array_contains(shown, k))))
        return (F.when(F.array_contains(wanted, f), value) if per_row else value).alias(f)

    return profiles.select(key, *[column(f) for f in K.OUTPUT_FIELDS if per_row or f in fields])
