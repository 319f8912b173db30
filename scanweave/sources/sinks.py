"""Profiles and verdicts out: nested files, response envelopes, report rows; and back in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave import schemas

MEDIA = "/media/documents/"


def with_artefact_links(profiles: DataFrame, fields=tuple(K.ENGINE_FIELDS), key="doc_id", root=MEDIA) -> DataFrame:
    """Where the page and crop images of a document are kept, under a stable name."""
    ident = F.format_string("%08x", F.col(key).cast("long"))  # eight digits at least, never cut
    crops = F.create_map(*[
        v for f in fields
        for v in (F.lit(f), F.concat(F.lit(f"{root}crop_{f}_"), ident, F.lit(".jpg")))
    ])
    return profiles.withColumn("image_url", F.concat(F.lit(f"{root}aligned_"), ident, F.lit(".jpg"))).withColumn("debug_crops", crops)


def scan_response(profiles: DataFrame, selected, key="doc_id") -> DataFrame:
    """Scan envelope as JSON: the profile twice under its two names, links, selection."""
    linked = with_artefact_links(profiles, key=key)
    body = F.struct(*[c for c in profiles.columns if c != key])
    return linked.select(key, F.to_json(F.struct(
        F.lit("success").alias("status"), body.alias("data"), body.alias("profile"),
        F.array(*[F.lit(f) for f in selected]).alias("selected_fields"), "debug_crops", "image_url",
    )).alias("response"))


def write_profiles(profiles: DataFrame, path, run_date, fmt="parquet") -> None:
    """Replaces the run of that date and leaves the others."""
    profiles.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").format(fmt).save(path)


def _shown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("N/A"))


def profile_report(profiles: DataFrame, key="doc_id") -> DataFrame:
    """Label and value rows of a profile; the address row only when there is an address."""
    a = "address_details"
    full = F.col(f"{a}.full_address") if "full_address" in profiles.schema[a].dataType.names else F.lit(None).cast("string")
    address = F.trim(F.coalesce(
        F.nullif(full, F.lit("")), F.nullif(F.col(f"{a}.raw_text"), F.lit("")),
        F.array_join(f"{a}.lines", ", "), F.lit("")))
    pairs = [
        ("Full Name", _shown(F.col("full_name"))), ("Date of Birth", _shown(F.col("dob"))),
        ("Father's Name", _shown(F.col("father_name"))), ("Gender", _shown(F.col("gender"))),
        ("State", _shown(F.col("location.state"))), ("Pincode", _shown(F.col("location.pincode"))),
        ("Full Address", F.nullif(address, F.lit(""))),
    ]
    return _rows(profiles, key, pairs).where("value is not null")


def verdict_report(verdicts: DataFrame, key="case_id") -> DataFrame:
    def yes(c):
        return F.when(F.col(c), "Yes").otherwise("No")

    return _rows(verdicts, key, [
        ("Account Exists", yes("account_valid")), ("PAN Owner Match", yes("pan_valid")),
        ("Payee Aadhaar Match", yes("payee_valid")), ("Signature Verified", yes("signature_valid")),
    ])


def _rows(df: DataFrame, key: str, pairs) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in pairs])
    return df.select(key, F.posexplode(rows).alias("position", "r")).select(key, "position", "r.label", "r.value")


def write_report(rows: DataFrame, path) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def profile_report_name(full_name: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(F.nullif(full_name, F.lit("")), F.lit("Scan_Result")), r"\s+", "_")
    return F.concat(F.lit("Profile_"), safe, F.lit(".pdf"))


def verdict_report_name(decision: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(F.nullif(decision, F.lit("")), F.lit("N/A")), r"\s+", "_")
    return F.concat(F.lit("Cheque_Validation_Report_"), safe, F.lit(".pdf"))


def verdict_envelope(at: Column = None) -> Column:
    """Response of a verification.  Unlike the original it also says whether the holder's
    name was found on the cheque, since that rule decides too."""
    return F.struct(
        F.lit("success").alias("status"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.struct(
            F.struct(
                F.col("account_valid").alias("account_exists"),
                F.col("cheque_name_valid").alias("cheque_name_match"),
                F.col("pan_valid").alias("pan_owner_match"),
                F.col("payee_valid").alias("payee_aadhaar_match"),
                F.col("signature_valid").alias("signature_verified"),
            ).alias("validation_details"),
            F.col("final_decision").alias("final_decision"),
            F.struct(F.lit("PaddleOCR v4").alias("ocr_engine"),
                     F.lit("Levenshtein Fuzzy").alias("matching_algorithm")).alias("engine_metadata"),
        ).alias("data"),
    )


def read_back(edited: DataFrame, column="json") -> DataFrame:
    """Edited profile JSON to a typed profile.  The profile is the object at ``data``, else at
    ``profile``, else the whole; anything but an object is an error."""
    def member(v, name):
        m = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(~F.coalesce(F.is_variant_null(m), F.lit(True)), m)

    # Columns of their own, one upon the other: each text is parsed and each object looked up
    # once, however often they are asked for.
    v = F.col("_parsed")
    parsed = edited.withColumn("_parsed", F.try_parse_json(F.col(column)))
    found = parsed.withColumn("_chosen", F.coalesce(member(v, "data"), member(v, "profile"), v)).drop("_parsed")
    is_object = F.coalesce(F.schema_of_variant("_chosen").startswith("OBJECT"), F.lit(False))
    judged = found.withColumn("_object", F.when(is_object, F.col("_chosen"))).drop("_chosen")
    known = F.col("_object").isNotNull()
    return judged.withColumn(
        "profile", F.when(known, F.from_json(F.to_json("_object"), schemas.PROFILE_JSON))
    ).withColumn("error", F.when(~known, F.lit('JSON must contain an object in "data".'))).drop("_object")
