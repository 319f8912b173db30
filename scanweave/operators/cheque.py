"""Cheque verification: three document texts and an account table to a verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.fuzzy import partial_ratio
from scanweave.functions.text import account_number, holder_name
from scanweave.operators.reads import document_text

DOCUMENT_TYPES = ("cheque", "pan", "aadhaar")


def assemble_cases(documents: DataFrame, key="case_id") -> DataFrame:
    """One row per case from one text per document; NULL where a document is missing."""
    return documents.groupBy(key).agg(*[
        F.max(F.when(F.col("doc_type") == t, F.col("text"))).alias(f"{t}_text") for t in DOCUMENT_TYPES
    ])


def cases_from_lines(lines: DataFrame, key="case_id") -> DataFrame:
    return assemble_cases(document_text(lines, (key, "doc_type")), key)


def complete_cases(cases: DataFrame) -> DataFrame:
    return cases.where(_complete())


def incomplete_cases(cases: DataFrame) -> DataFrame:
    return cases.where(~_complete()).withColumn("error", F.lit("Missing required documents."))


def _complete() -> Column:
    present = [F.col(f"{t}_text").isNotNull() for t in DOCUMENT_TYPES]
    return present[0] & present[1] & present[2]


def register_accounts(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(register, quarantine) of an account table as it was delivered.

    The register holds each number once, with the smallest holder where a number came with
    several.  Quarantined are rows without a number or with one too long for the register, and
    what a repeated number has beyond its registered row; ``copies`` says how often a row came.
    Numbers that repeat are counted on the map side, so one number may have any number of rows.
    """
    others = [c for c in accounts.columns if c not in ("account_number", "account_holder_name")]
    number, row = F.col("account_number"), ["account_holder_name", *others]
    fault = F.when(F.coalesce(F.trim(number), F.lit("")) == "", "Missing account number.").when(
        F.length(number) > K.ACCOUNT_NUMBER_LENGTH, "Account number too long.")
    counted = accounts.groupBy("account_number", *row).agg(F.count(F.lit(1)).alias("copies")).withColumn("reason", fault)
    sound = counted.where("reason is null")
    first = sound.groupBy("account_number").agg(F.min(F.struct(*row)).alias("kept"), F.sum("copies").alias("rows"))
    register = first.select("account_number", "kept.*")
    repeated = first.where("rows > 1").select("account_number", "kept")
    spare = F.col("copies") - F.struct(*row).eqNullSafe(F.col("kept")).cast("long")
    extra = sound.join(repeated, "account_number").withColumn("copies", spare).where("copies > 0").withColumn(
        "reason", F.lit("Account number already registered."))
    columns = ("account_number", *row, "copies", "reason")
    return register, counted.where("reason is not null").select(*columns).unionByName(extra.select(*columns))


def look_up_accounts(cases: DataFrame, accounts: DataFrame, key="case_id") -> DataFrame:
    """Adds account_number and the holder on file.  ``accounts`` hold each number once, which
    ``register_accounts`` sees to when a table is loaded; so the join is a plain one, whose
    skewed side adaptive execution can split when one account has a large share of the cases.
    Cases without a number get a key of their own that matches nothing, so they do not pile
    up in one partition."""
    with_number = cases.withColumn("account_number", account_number(F.col("cheque_text"))).withColumn(
        "_key", F.when(F.col("account_number") != "", F.col("account_number"))
        .otherwise(F.concat(F.lit("none-"), F.col(key).cast("string"))))
    on_file = accounts.select(F.col("account_number").alias("_key"), "account_holder_name")
    return with_number.join(on_file, "_key", "left").drop("_key")


def verify_cheques(cases: DataFrame, accounts: DataFrame, key="case_id") -> DataFrame:
    """Verdict per case.  The name rules count only for an account on file; the signature is
    not examined and always passes."""
    found = look_up_accounts(complete_cases(cases), accounts, key)
    on_file = F.col("account_holder_name").isNotNull()
    holder = F.upper("account_holder_name")
    payee = holder_name(F.col("aadhaar_text"))
    scored = found.select(
        key, "account_number",
        on_file.alias("account_valid"),
        payee.alias("payee_name"),
        (partial_ratio(holder, F.col("pan_text")) > K.PAN_MIN_SCORE).alias("pan_hit"),
        (partial_ratio(holder, F.col("cheque_text")) > K.CHEQUE_MIN_SCORE).alias("name_hit"),
        (partial_ratio(F.when(on_file & (payee != ""), payee), F.col("cheque_text")) > K.PAYEE_MIN_SCORE).alias("payee_hit"),
    )
    verdict = scored.select(
        key, "account_number", "payee_name", "account_valid",
        F.coalesce("name_hit", F.lit(False)).alias("cheque_name_valid"),
        F.coalesce("pan_hit", F.lit(False)).alias("pan_valid"),
        F.coalesce("payee_hit", F.lit(False)).alias("payee_valid"),
        F.lit(True).alias("signature_valid"),
    )
    passed = (
        F.col("account_valid") & F.col("cheque_name_valid") & F.col("pan_valid")
        & F.col("payee_valid") & F.col("signature_valid")
    )
    return verdict.withColumn("final_decision", F.when(passed, "Approved").otherwise("Rejected"))


def verdicts_or_errors(cases: DataFrame, accounts: DataFrame, key="case_id") -> DataFrame:
    """A row for every case: the verdict, or the error of a case that lacks a document."""
    judged = verify_cheques(cases, accounts, key).withColumn("error", F.lit(None).cast("string"))
    return judged.unionByName(incomplete_cases(cases).select(key, "error"), allowMissingColumns=True)


def search_accounts(accounts: DataFrame, term) -> DataFrame:
    """Accounts whose number or holder contains the term, case ignored."""
    needle = F.lower(term if isinstance(term, Column) else F.lit(term))
    return accounts.where(
        F.contains(F.lower("account_number"), needle) | F.contains(F.lower("account_holder_name"), needle)
    ).select("account_number", "account_holder_name")
