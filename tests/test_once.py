"""What several parts of a result use is worked out once per row."""

import re

from pyspark.sql import functions as F

from scanweave.functions.address import parse_address
from scanweave.functions.dates import clean_dob, dob_from_parts
from scanweave.functions.fields import parse_fields
from scanweave.operators import profile, refine
from scanweave.plans import jobs
from scanweave.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_taken_apart_once(spark):
    df = spark.createDataFrame([("", "", "", ["MG ROAD"])], "raw string, pin string, state string, lines array<string>")
    plan = plan_of(df.select(parse_address(*[F.col(c) for c in df.columns]).alias("a")))
    assert plan.count("{6}\\b(.*)$") == 1 and plan.count("= INDIA)") == 1


def test_words_are_split_without_an_expression(spark):
    df = spark.createDataFrame([("",)], "raw string")
    none = F.lit(None).cast("array<string>")
    plan = plan_of(df.select(parse_address(F.col("raw"), F.lit(""), F.lit(""), none).alias("a")))
    assert "split(" in plan and ",  +, -1" not in plan


def test_a_payload_is_parsed_once(spark):
    df = spark.createDataFrame([("dob",)], "p string")
    assert len(re.findall(r"parseJson|parse_json", plan_of(df.select(parse_fields(F.col("p")).alias("f"))))) == 1


def test_requested_fields_are_looked_up_outside_the_entries(spark):
    shape = "doc_id int, full_name string, father_name string, dob string, gender string, location string, address_details string"
    row = (1, "", "", "", "", "", "", {"dob": 1, "name": 2}, {"dob": "a", "name": "b"}, ["dob", "confidence_metrics"])
    df = spark.createDataFrame([row], f"{shape}, confidence_metrics map<string,int>, raw_extracted_text map<string,string>, fields array<string>")
    shown = profile.project_profile(df, F.col("fields"))
    assert shown.collect()[0].confidence_metrics == {"dob": 1}
    inside = re.findall(r"map_filter\([^#]*#\d+, lambdafunction\(array_contains\((\w+)", plan_of(shown))
    assert inside == ["lambda", "lambda"]


def test_an_edited_profile_is_parsed_once(spark):
    df = spark.createDataFrame([('{"data": {"full_name": "A"}}',), ('{"profile": {"dob": "x"}}',), ('{"data": [1]}',), ("{",), (None,), ('{"data": null, "full_name": "B"}',)], "json string")
    out = sinks.read_back(df)
    assert out.columns == ["json", "profile", "error"]
    assert [(r.profile and (r.profile.full_name, r.profile.dob), r.error is None) for r in out.collect()] == [
        (("A", None), True), ((None, "x"), True), (None, False), (None, False), (None, False), (("B", None), True)]
    assert len(re.findall(r"parseJson|parse_json", plan_of(out))) == 1


def test_a_date_is_read_once(spark):
    df = spark.createDataFrame([("1l", "O2", "1954")], "d string, m string, y string")
    out = df.select(dob_from_parts(F.col("d"), F.col("m"), F.col("y")).alias("t"))
    assert out.collect()[0].t == "11/02/1954"
    assert plan_of(out).count("regexp_replace") == 3
    free = df.select(clean_dob(F.col("y")).alias("t"))
    assert plan_of(free).count("regexp_instr") == 1


def test_the_leakage_text_is_normalized_once(spark):
    df = spark.createDataFrame([("name", "FATHER NAME")], "field string, raw_text string")
    assert plan_of(refine.with_leakage(df)).count("[^\\p{L}\\p{N}]+") == 1


def test_a_state_text_is_cleaned_once(spark):
    df = spark.createDataFrame([("state", "BIHAR")], "field string, raw_text string")
    out = jobs.clean_reads(df)
    assert out.collect()[0].clean_text == "BIHAR"
    # the cleaning drops words of one or two letters for names, and for states
    assert plan_of(out).count("[A-Z]{1,2}") == 2
