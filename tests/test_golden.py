"""Literal facts every implementation of these rules has to reproduce."""

from pyspark.sql import functions as F

from scanweave.functions import dates, fields, fuzzy, gender, pin, text
from scanweave.functions.address import parse_address


def test_pin(values):
    got = values(pin.clean_pin, [("ISL6LTL2ITLO",), ("56L210",), ("560001",), ("PIN CODE 560001",), ("",), (None,)], "t string")
    assert got == ["561210", "561210", "560001", "560001", "", ""]


def test_state(values):
    fn = lambda t: fuzzy.fuzzy_choice(text.clean_state_text(t))
    assert values(fn, [("KARNATAYA",), ("GOA",), ("QQQQQQ",), ("",), ("tamil-nadu",)], "t string") == [
        "KARNATAKA", "GOA", "QQQQQQ", "", "TAMIL NADU"]


def test_dob_parts(values):
    rows = [("01", "01", "145Y"), ("01", "01", "1454"), ("31", "02", "1990"), ("1", "02", "1990"), ("O1", "I2", "57"), ("01", "01", "20")]
    assert values(dates.dob_from_parts, rows, "d string, m string, y string") == [
        "01/01/1957", "01/01/1954", "", "", "01/12/1957", "01/01/2020"]


def test_dob_text_reads_a_slash_as_seven_unless_told_otherwise(values):
    assert values(dates.clean_dob, [("01/01/1957",)], "t string") == [""]
    assert values(lambda t: dates.clean_dob(t, slash_is_separator=True), [("01/01/1957",)], "t string") == ["01/01/1957"]


def test_address_line(values):
    rows = [("SO! GANGHPPA",), ("H CSUR",), ("A B C D",), ("A BAT C BAT D",), ("MAIN ROAD X",), ("S GANGAPPA",), ("",)]
    assert values(text.address_line, rows, "t string") == ["S/O GANGHPPA", "HCSUR", "AB CD", "ABATCBAT", "MAIN ROAD", "SGANGAPPA", ""]


def test_spaced_letters_merge_in_pairs(values):
    assert values(text.clean_generic, [("G A N G",), ("étage é A",)], "t string") == ["GA NG", "TAGE A"]


def test_parse_address(values):
    lines = ["S/O GANGAPPA", "SCNAGANAHALLI", "HCSUR", "GAUDIBIDANUR", "CHIKBALLAPUR"]
    got = values(lambda ls: parse_address(F.lit(""), F.lit("561210"), F.lit("KARNATAKA"), ls), [(lines,)], "ls array<string>")[0]
    assert got["address_line_1"] == "S/O GANGAPPA"
    assert got["area_or_locality"] == got["area"] == "GAUDIBIDANUR"
    assert got["city"] == got["district"] == got["town_or_city"] == "CHIKBALLAPUR"
    assert got["pin_code"] == "561210" and got["country"] == "INDIA"


def test_gender(spark):
    scores = [
        ([("Male", .28), ("Female", .10), ("Transgender", .30)],),
        ([("Male", .05), ("Female", .04), ("Transgender", .55)],),
        ([],), (None,),
        ([("Transgender", 0.0), ("Male", 0.0), ("Female", 0.0)],),
    ]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(scores)], "i int, s array<struct<label:string,score:double>>")
    got = [r["g"] for r in df.select("i", gender.resolve_gender(F.col("s")).alias("g")).orderBy("i").collect()]
    assert got[0]["gender"] == "Male" and got[0]["confidence"] > 0
    assert got[1]["gender"] == "Transgender" and got[1]["confidence"] > 0.2
    assert [g["gender"] for g in got[2:]] == ["Male"] * 3


def test_requested_fields(values):
    rows = [
        ('["full_name", "dob", "raw_extracted_text"]',), ('["confidence_metrics", "raw_extracted_text"]',),
        ("dob,gender",), ('{"a": 1}',), ('["dob", 3, null, true]',), (None,), ('["dob"] x',)]
    got = values(fields.parse_fields, rows, "t string")
    assert got[0]["fields"] == ["full_name", "dob", "raw_extracted_text"] and got[0]["error"] is None
    assert got[1]["fields"] is None and got[1]["error"] == "Select at least one extraction field."
    assert got[2]["fields"] == ["dob", "gender"]
    assert got[3]["error"] == "Invalid fields payload."
    assert got[4]["error"] == "Unsupported fields: 3, None, True"
    assert len(got[5]["fields"]) == 8
    assert got[6]["error"] == 'Unsupported fields: ["dob"] x'


def test_account_number_and_holder(values):
    rows = [("A/C 123456789 OR 987654321 OR 12345678901",), ("1234567890123456789",), ("no 12345678",), ("x123456789",)]
    assert values(text.account_number, rows, "t string") == ["12345678901", "", "", ""]
    assert values(text.holder_name, [("Government of India RAVI K. KUMAR, Male",), ("DOB 12",), ("SINGH",)], "t string") == [
        "RAVI KUMAR", "", "SINGH"]


def test_year_tail_repair(values):
    rows = [("01/01/1954", "01 01 1954", "7", "V"), ("01/01/1954", "01 01 1954", "", ""), ("01/01/1964", "01 01 1964", "7", "Y")]
    got = values(dates.repair_year_tail, rows, "d string, r string, h string, l string")
    assert [tuple(g) for g in got] == [
        ("01 01 195V", "01/01/1957"), ("01 01 1954", "01/01/1954"), ("01 01 1964", "01/01/1964")]
