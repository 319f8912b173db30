"""Cheque cases verified as they arrive.

A case arrives whole, with its three texts, so verification keeps no state: a stream of
cases against a static account table, with the same operators as the batch job.
"""

from pyspark.sql import DataFrame, SparkSession

from scanweave.operators.cheque import verdicts_or_errors, verify_cheques

CASE_SCHEMA = "case_id bigint, cheque_text string, pan_text string, aadhaar_text string"


def read_cases(spark: SparkSession, path, max_files=1000) -> DataFrame:
    return spark.readStream.schema(CASE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_verdicts(cases: DataFrame, accounts: DataFrame, out, checkpoint, trigger=None, errors=False):
    """Starts the query; ``checkpoint`` belongs on storage every executor can reach.  With
    ``errors``, a case that lacks a document gets a row too, with its error."""
    judged = (verdicts_or_errors if errors else verify_cheques)(cases, accounts)
    writer = judged.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.start(out)
