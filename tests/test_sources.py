import json
import struct
import zlib

from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.operators import calibration, cheque, profile
from scanweave.plans import recipes
from scanweave.sources import intake, sinks, templates


def png(width, height):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = b"".join(b"\x00" + b"\xff\xff\xff" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(5, 3))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    (tmp_path / "c.gif").write_bytes(b"GIF89a")
    (tmp_path / "d.png").write_bytes(b"")
    docs = intake.with_intake_error(intake.scan_images(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: (r["mime"], r["error"]) for r in docs.collect()}
    # The file source skips an empty file, so it never becomes a document.
    assert got == {"a.png": ("image/png", None), "b.jpg": ("image/jpeg", None), "c.gif": ("", None)}
    sizes = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["decoded"]) for r in intake.probe_images(spark, str(tmp_path)).collect()}
    assert sizes["a.png"] == (5, 3, True) and not sizes["b.jpg"][2]


def test_images_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(2, 2))
    stream = intake.with_intake_error(intake.scan_images(spark, str(tmp_path / "in"), stream=True)).select("path", "error")
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_recogniser_json(spark):
    raws = [
        (1, 1, json.dumps([[[[[0, 0], [9, 0], [9, 5], [0, 5]], ["hello ", 0.5]], [[[1, 8], [2, 8], [2, 9], [1, 9]], ["b", 1]]]])),
        (2, 2, json.dumps([[["no box", 0.25]]])), (3, 3, "[null]"), (4, 4, "broken"),
    ]
    df = spark.createDataFrame(raws, "doc_id long, read_id long, raw string")
    got = {(r["doc_id"], r["line_no"]): r for r in intake.flatten_recogniser_json(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert got[1, 0]["text"] == "HELLO" and got[1, 0]["score"] == 0.5 and got[1, 0]["box"][2].y == 5.0
    assert got[2, 0]["text"] == "NO BOX" and got[2, 0]["box"] is None and got[2, 0]["score"] == 0.25


def test_recogniser_hook(spark):
    def shout(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["body"].str.upper()})

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, body string")
    assert {tuple(r) for r in intake.recognise(docs, shout, "doc_id long, text string").collect()} == {(1, "A"), (2, "B")}


def test_accounts(spark, tmp_path):
    rows = [("123456789", "RAVI KUMAR", None), ("987654321", "Anna", "/s.png")]
    spark.createDataFrame(rows, "account_number string, account_holder_name string, signature_reference_path string").write.parquet(str(tmp_path / "a"))
    accounts = intake.read_accounts(spark, str(tmp_path / "a"))
    assert [r[0] for r in cheque.search_accounts(accounts, "aNN").collect()] == ["987654321"]
    assert [r[0] for r in cheque.search_accounts(accounts, "3456").collect()] == ["123456789"]
    assert intake.duplicate_accounts(accounts).count() == 0
    assert intake.duplicate_accounts(accounts.unionByName(accounts)).count() == 2


def test_templates(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "bank.json").write_text(json.dumps({"pin": [0.1, 0.2, 0.3, 0.4], "stamp": [0, 0, 1, 1]}))
    (tmp_path / "t" / "bad.json").write_text("{oops")
    loaded = templates.load_templates(spark, str(tmp_path / "t"))
    got = {(r["template_id"], r["field"]): tuple(r)[2:] for r in loaded.collect()}
    assert got["bank", "pin"] == (0.1, 0.2, 0.3, 0.4) and got["bank", "stamp"] == (0.0, 0.0, 1.0, 1.0)
    assert got["bank", "name"] == tuple(K.DEFAULT_ROIS["name"]) and got["bad", "pin"] == tuple(K.DEFAULT_ROIS["pin"])
    update = spark.createDataFrame([("bank", "pin", 0.5, 0.5, 0.6, 0.6)], templates.default_templates(spark).schema)
    merged = calibration.merge_templates(loaded, update)
    assert {r["x1"] for r in merged.where("template_id = 'bank' and field = 'pin'").collect()} == {0.5}
    assert merged.count() == loaded.count()
    templates.save_templates(merged, str(tmp_path / "saved"))
    saved = spark.read.json(str(tmp_path / "saved"), schema="template_id string, rois map<string,array<double>>")
    assert {r["template_id"]: len(r["rois"]) for r in saved.collect()} == {"bank": 8, "bad": 7}
    again = templates.load_templates(spark, str(tmp_path / "saved"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.select(again.columns).collect()))


def test_profile_files_and_reports(spark, sf_dir, tmp_path):
    profiles = profile.assemble_profiles(recipes.profile_results(spark, sf_dir))
    sinks.write_profiles(profiles, str(tmp_path / "p"), "2026-01-01")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == profiles.count() and [str(r[0]) for r in back.select("run_date").distinct().collect()] == ["2026-01-01"]
    sinks.write_profiles(profiles, str(tmp_path / "p"), "2026-01-02")
    both = spark.read.parquet(str(tmp_path / "p"))
    assert both.count() == 2 * profiles.count() and both.select("run_date").distinct().count() == 2
    sinks.write_report(sinks.profile_report(profiles), str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).columns == ["doc_id", "position", "label", "value"]
    body = json.loads(sinks.scan_response(profiles, ["full_name"]).first()["response"])
    assert body["status"] == "success" and body["data"] == body["profile"] and "/crop_pin_" in body["debug_crops"]["pin"]


def test_projection_by_list_drops_columns(spark, sf_dir):
    profiles = profile.assemble_profiles(recipes.profile_results(spark, sf_dir))
    shown = profile.project_profile(profiles, ["full_name", "dob", "confidence_metrics"])
    assert shown.columns == ["doc_id", "full_name", "dob", "confidence_metrics"]
    assert set(shown.first()["confidence_metrics"]) == {"name", "dob"}


def test_read_back(spark):
    rows = [('{"data": {"full_name": "A"}}',), ('{"profile": {"full_name": "B"}}',), ('{"full_name": "C"}',), ("[1]",), ('{"data": 5}',), ("{",), ('{"data": null, "full_name": "D"}',)]
    got = sinks.read_back(spark.createDataFrame(rows, "json string")).collect()
    assert [r["profile"] and r["profile"]["full_name"] for r in got] == ["A", "B", "C", None, None, None, "D"]
    assert [r["error"] is None for r in got] == [True, True, True, False, False, False, True]


def test_broken_recogniser_output_is_kept(spark):
    raws = [(1, None), (2, "{"), (3, "7"), (4, '{"a": []}'), (5, "[null]"), (6, "[[]]"), (7, "[]"),
            (8, '[[["a", 0.5], 7, ["b"], [[[0, 1], [2, 3]], ["c", 0.25]], [[[0, 1]], 5]]]')]
    df = spark.createDataFrame(raws, "doc_id long, raw string")
    got = {}
    for r in intake.recogniser_lines(df, keys=("doc_id",)).collect():
        got.setdefault(r["doc_id"], []).append((r["line_no"], r["text"], r["fault"]))
    broken = "Not a line."
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {
        1: [(None, None, "Not JSON.")], 2: [(None, None, "Not JSON.")], 3: [(None, None, "Not a page.")], 4: [(None, None, "Not a page.")],
        7: [(None, None, "Not a page.")],
        8: [(0, "A", None), (1, None, broken), (2, None, broken), (3, "C", None), (4, None, broken)]}
