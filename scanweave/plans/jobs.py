"""The two whole jobs: forms to profiles, and cheque cases to verdicts."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.dates import DEFAULT_CURRENT_YEAR
from scanweave.functions.fields import required_engine_fields
from scanweave.functions.pin import clean_pin
from scanweave.functions.fuzzy import fuzzy_choice
from scanweave.functions.text import clean_generic, clean_name, clean_state_text
from scanweave.functions.dates import clean_dob
from scanweave.operators.address import address_vote
from scanweave.operators.cheque import cases_from_lines, verdicts_or_errors
from scanweave.operators.consensus import consensus
from scanweave.operators.dob import resolve_dob
from scanweave.operators.gender import gender_field
from scanweave.operators.profile import assemble_profiles, project_profile

RESULT = ("doc_id", "field", "raw_text", "clean_text", "confidence", "address_lines")


def clean_reads(reads: DataFrame, current_year=DEFAULT_CURRENT_YEAR) -> DataFrame:
    """Cleaned text by field.  The fuzzy state choice is a Python step, so it only gets the
    state rows; the other fields stay in generated code."""
    raw, field = F.col("raw_text"), F.col("field")
    clean = (
        F.when(field.isin(K.NAME_FIELDS), clean_name(raw))
        .when(field == "pin", clean_pin(raw))
        .when(field == "dob", clean_dob(raw, current_year))
        .when(field == "state", fuzzy_choice(F.col("_state")))
        .otherwise(clean_generic(raw))
    )
    # The state text is a column of its own, since the choice asks for it several times.
    stated = reads.withColumn("_state", F.when(field == "state", clean_state_text(raw)))
    return stated.withColumn("clean_text", clean).withColumn("raw_text", F.trim("raw_text")).drop("_state")


def field_results(text_reads=None, address_reads=None, address_lines=None, box_reads=None, tail_reads=None,
                  segment_reads=None, dob_reads=None, gender_scores=None, gender_reads=None, documents=None,
                  output_fields=None, current_year=DEFAULT_CURRENT_YEAR) -> DataFrame:
    """One row per document and field from whatever reads are given; each of them is optional.
    Only the fields the requested outputs need are worked on.  With ``documents`` (their keys),
    a document without any read gets one row without a field."""
    needed = {f for o in (output_fields or K.PRIMARY_FIELDS) for f in K.REQUIRED_ENGINE_FIELDS.get(o, [])} or set(K.ENGINE_FIELDS)
    text_fields = [f for f in ("name", "father_name", "state", "pin") if f in needed]
    none = F.lit(None).cast("array<string>")
    parts = []

    def add(field, found):
        parts.append(found.withColumns({"field": F.lit(field), "address_lines": none}))

    if text_fields and text_reads is not None:
        parts.append(consensus(clean_reads(text_reads.where(F.col("field").isin(text_fields)), current_year))
                     .withColumn("address_lines", none))
    if "address" in needed and (address_reads is not None or address_lines is not None):
        parts.append(address_vote(address_reads, address_lines).withColumn("field", F.lit("address")))
    if "dob" in needed and any(r is not None for r in (box_reads, segment_reads, dob_reads)):
        add("dob", resolve_dob(box_reads, tail_reads, segment_reads, dob_reads, current_year))
    if "gender" in needed and gender_scores is not None:
        add("gender", gender_field(gender_scores, gender_reads))
    if documents is not None:
        text = F.lit(None).cast("string")
        parts.append(documents.select("doc_id").distinct().withColumns({
            "field": text, "raw_text": text, "clean_text": text, "confidence": F.lit(None).cast("double"), "address_lines": none}))
    if not parts:
        raise ValueError("no reads for the requested outputs, and no documents")
    return functools.reduce(DataFrame.unionByName, [p.select(*RESULT) for p in parts])


def extract_profiles(output_fields=None, **reads) -> DataFrame:
    """Profiles with the requested outputs (all by default), from any of the reads that
    ``field_results`` takes.  With ``documents``, each of them has a profile, the default one
    where nothing was read."""
    results = field_results(output_fields=output_fields, **reads)
    return project_profile(assemble_profiles(results), output_fields or K.OUTPUT_FIELDS)


#: the engine field that each kind of reads serves; text reads name theirs
READS_FOR = {
    "address_reads": "address", "address_lines": "address", "box_reads": "dob", "tail_reads": "dob", "segment_reads": "dob",
    "dob_reads": "dob", "gender_scores": "gender", "gender_reads": "gender",
}


def requested_profiles(requests: DataFrame, **reads) -> DataFrame:
    """One profile per request (doc_id, fields: the outputs wanted), different outputs for every
    document.  Reads that no output of their document needs are dropped before anything is
    cleaned or voted on, by semi joins with the requests.  A document has one request."""
    needs = requests.select("doc_id", F.explode(required_engine_fields(F.col("fields"))).alias("field"))

    def needed(kind, given):
        field = READS_FOR.get(kind)
        if field is None:
            return given.join(needs, ["doc_id", "field"], "left_semi")
        return given.join(needs.where(F.col("field") == field).select("doc_id"), "doc_id", "left_semi")

    results = field_results(documents=requests, **{k: needed(k, r) for k, r in reads.items() if r is not None})
    return project_profile(assemble_profiles(results).join(requests.select("doc_id", "fields"), "doc_id"), F.col("fields"))


def verify_documents(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Recognised lines of the documents of each case, to a verdict or an error per case.
    ``accounts`` is the register that ``sources.intake.load_accounts`` wrote."""
    return verdicts_or_errors(cases_from_lines(lines), accounts)
