"""Whole jobs on small hand-made tables, and the stream against the batch."""

from pyspark.sql import functions as F

from scanweave.operators.cheque import verify_cheques
from scanweave.plans import jobs, recipes
from scanweave.streaming import cheques

TEXT = "doc_id long, field string, ordinal int, raw_text string, confidence double"
ADDRESS = "doc_id long, line_idx int, ordinal int, variant string, raw_text string, confidence double"
BOXES = "doc_id long, box_set int, box_idx int, ordinal long, kind string, raw_text string, confidence double"
CROPS = "doc_id long, crop int, ordinal int, raw_text string, confidence double"
SEGMENTS = "doc_id long, segment string, ordinal int, raw_text string, confidence double"


def reads(spark):
    text = [(1, f, i, t, c) for f, items in {
        "name": [("NARASEMHAPPA", .93), ("NARASEMHAPPA", .93), ("NARASE", .4)],
        "father_name": [("GANGAPPA", .9), ("CANGAPPA", .5)],
        "state": [("KARNATAYA", .86), ("KARNATAKA", .86)],
        "pin": [("56L210", .92), ("561210", .92)],
    }.items() for i, (t, c) in enumerate(items)]
    lines = ["SO GANGHPPA", "QCNAGANAHALLI", "H CSUQ", "GAUDIBIDANUA", "CHIKKABALLAPUR"]
    return {
        "text_reads": spark.createDataFrame(text, TEXT),
        "address_reads": spark.createDataFrame([(1, i, i, "base", t, .88) for i, t in enumerate(lines)], ADDRESS),
        "box_reads": spark.createDataFrame([(1, 0, i, 0, "vote", c, 5.28) for i, c in enumerate("01011954")], BOXES),
        "tail_reads": spark.createDataFrame([(1, 0, 0, "195Y", .8)], CROPS),
        "segment_reads": spark.createDataFrame([(2, "day", 0, "01", .5)], SEGMENTS),
        "dob_reads": spark.createDataFrame([(1, 0, "01 01 1999", .9)], "doc_id long, ordinal int, raw_text string, confidence double"),
        "gender_scores": spark.createDataFrame([(1, "Male", 0, .9), (1, "Female", 1, .1), (1, "Transgender", 2, .1)], "doc_id long, label string, ordinal int, score double"),
        "gender_reads": spark.createDataFrame([(1, "MALE FEMALE TRANSGENDER", .77)], "doc_id long, raw_text string, confidence double"),
    }


def test_profile_of_a_form(spark):
    p = jobs.extract_profiles(**reads(spark)).collect()[0]
    assert p["full_name"] == "NARASEMHAPPA" and p["father_name"] == "GANGAPPA" and p["gender"] == "Male"
    assert p["location"].pincode == "561210" and p["location"].state == "KARNATAKA"
    assert p["dob"] == "01/01/1957" and p["raw_extracted_text"]["dob"] == "01 01 195Y"
    a = p["address_details"]
    assert a.address_line_1 == "S/O GANGAPPA" and a.lines[1:3] == ["QCNAGANAHALLI", "HCSUQ"]
    assert a.city == a.district == a.town_or_city == "CHIKKABALLAPUR"
    assert p["confidence_metrics"]["name"].score_percentage == 93.0 and not p["confidence_metrics"]["name"].needs_review


def test_requested_outputs_limit_the_work(spark):
    p = jobs.extract_profiles(output_fields=["full_name", "dob", "confidence_metrics"], **reads(spark))
    assert p.columns == ["doc_id", "full_name", "dob", "confidence_metrics"]
    assert set(p.collect()[0]["confidence_metrics"]) == {"name", "dob"}


def test_cheque_rules(spark):
    accounts = spark.createDataFrame([("123456789", "Ravi Kumar")], "account_number string, account_holder_name string")
    cases = [
        (1, "PAY ANNA SMITH 123456789 RAVI KUMAR", "RAVI KUMAR PAN", "GOVT OF INDIA ANNA SMITH"),
        (2, "PAY ANNA SMITH 999999999 RAVI KUMAR", "RAVI KUMAR PAN", "ANNA SMITH"),
        (3, "PAY SOMEONE 123456789 RAVI KUMAR", "RAVI KUMAR", "ANNA SMITH"),
        (4, "PAY ANNA SMITH 123456789 RAVI KUMAR", "OTHER PERSON", "ANNA SMITH"),
        (5, "PAY ANNA 123456789 RAVI KUMAR", "RAVI KUMAR", "12 34"),
        (6, "PAY ANNA", None, "ANNA"),
    ]
    df = spark.createDataFrame(cases, "case_id long, cheque_text string, pan_text string, aadhaar_text string")
    got = {r["case_id"]: r for r in verify_cheques(df, accounts).collect()}
    assert {k: v["final_decision"] for k, v in got.items()} == {1: "Approved", 2: "Rejected", 3: "Rejected", 4: "Rejected", 5: "Rejected"}
    assert not got[2]["account_valid"] and not got[2]["pan_valid"] and not got[3]["payee_valid"] and not got[4]["pan_valid"]
    assert got[5]["payee_name"] == "" and not got[5]["payee_valid"] and got[5]["signature_valid"]


def test_lines_to_verdict(spark):
    accounts = spark.createDataFrame([("123456789", "RAVI KUMAR")], "account_number string, account_holder_name string")
    lines = [(1, t, i, x) for t, xs in {"cheque": ["pay anna smith", "123456789", "ravi kumar"], "pan": ["ravi", "kumar"], "aadhaar": ["anna", "smith"]}.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(lines, "case_id long, doc_type string, line_no int, text string")
    assert jobs.verify_documents(df, accounts).first()["final_decision"] == "Approved"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    cases, accounts = recipes.case_texts(spark, sf_dir), recipes.bank_accounts(spark, sf_dir)
    cases.repartition(4).write.parquet(str(tmp_path / "in"))
    q = cheques.stream_verdicts(cheques.read_cases(spark, str(tmp_path / "in"), 2), accounts, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = verify_cheques(cases, accounts)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_any_of_the_reads_is_enough(spark):
    every = reads(spark)
    dated = {k: every[k] for k in ("dob_reads",)}
    p = jobs.extract_profiles(**dated).collect()
    assert [(r["doc_id"], r["dob"], r["full_name"], r["gender"]) for r in p] == [(1, "01/01/1999", "", "Male")]
    # boxes without hints for their tail: the year stays as it was voted, and wins over the whole crop
    p = jobs.extract_profiles(box_reads=every["box_reads"], **dated).first()
    assert p["dob"] == "01/01/1954"
    p = jobs.extract_profiles(box_reads=every["box_reads"], tail_reads=every["tail_reads"]).first()
    assert p["dob"] == "01/01/1957"
    lines = spark.createDataFrame([(4, 0, 0, "S/O GANGAPPA", .9, None), (4, 0, 1, "MAIN ROAD", .7, None)],
                                  "doc_id long, ordinal int, line_no int, text string, score double, box array<struct<x:double,y:double>>")
    p = jobs.extract_profiles(address_lines=lines).first()
    assert p["address_details"].lines == ["S/O GANGAPPA", "MAIN ROAD"]
    p = jobs.extract_profiles(gender_scores=every["gender_scores"]).first()
    assert p["gender"] == "Male" and set(p["raw_extracted_text"]) == {"gender"}


def test_documents_without_reads_have_a_default_profile(spark):
    every = reads(spark)
    documents = spark.createDataFrame([(1,), (7,), (7,)], "doc_id long")
    got = {r["doc_id"]: r for r in jobs.extract_profiles(documents=documents, **every).collect()}
    assert set(got) == {1, 7} and got[1]["full_name"] == "NARASEMHAPPA"
    empty = got[7]
    assert (empty["full_name"], empty["dob"], empty["gender"], empty["father_name"]) == ("", "", "Male", "")
    assert tuple(empty["location"]) == ("", "", "INDIA") and empty["confidence_metrics"] == {} and empty["raw_extracted_text"] == {}
    only = jobs.extract_profiles(documents=documents).collect()
    assert sorted(r["doc_id"] for r in only) == [1, 7]
    try:
        jobs.extract_profiles(tail_reads=every["tail_reads"])
    except ValueError:
        return
    raise AssertionError("tails alone are no reads of a field")


def test_stream_tells_of_incomplete_cases(spark, tmp_path):
    accounts = spark.createDataFrame([("123456789", "RAVI KUMAR")], "account_number string, account_holder_name string")
    rows = [(1, "123456789 RAVI KUMAR", "RAVI KUMAR", "RAVI KUMAR"), (2, "x", None, "y")]
    spark.createDataFrame(rows, cheques.CASE_SCHEMA).write.parquet(str(tmp_path / "in"))
    q = cheques.stream_verdicts(cheques.read_cases(spark, str(tmp_path / "in")), accounts, str(tmp_path / "out"), str(tmp_path / "cp"), errors=True)
    q.awaitTermination(300)
    got = {r["case_id"]: (r["final_decision"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("Approved", None), 2: (None, "Missing required documents.")}
