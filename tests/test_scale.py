"""Plans and results where one page, account, template or group holds much of the data."""

import random

import pytest
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.operators import cheque, consensus, layout, templates
from scanweave.sources import intake

BOX = "array<struct<x:double,y:double>>"


@pytest.fixture
def skewed(spark):
    """No broadcast joins, and every partition some times the median counts as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k in wanted:
        spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_million_lines_without_a_gap(spark):
    n = 1_000_000
    lines = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.lit("W").alias("text"),
        F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (
            (F.col("id") % 7 * 10, F.col("id") * 9), (F.col("id") % 7 * 10 + 5, F.col("id") * 9 + 12))]).alias("box"),
        F.lit(2200).alias("height"))
    assert layout.page_blocks(layout.layout_items(lines)).select("block").distinct().count() == 1
    rows = layout.layout_rows(lines)
    top = low = count = 0
    for i in range(n):
        y1, y2 = i * 9, i * 9 + 12
        if i and abs((y1 + y2) / 2 - (top + low) / 2) <= 17:
            top, low = min(top, y1), max(low, y2)
        else:
            count, top, low = count + 1, y1, y2
    got = rows.agg(F.count("*"), F.sum("token_count"), F.max("row"), F.countDistinct("row")).first()
    assert tuple(got) == (count, n, count - 1, count)


def test_rows_go_on_over_batches(spark):
    """A row longer than a batch, rows and pages that end with one."""
    rng = random.Random(4)
    rows, want = [], set()
    for doc in range(6):
        y, items = 0, []
        for r in range(20):
            size = rng.choice([1, 2, 3, 40])
            words = [(rng.randrange(1500), f"R{r}W{i}") for i in range(size)]
            items += [(x, y, w) for x, w in words]
            want.add((doc, r, " ".join(w for _, w in sorted(words, key=lambda p: (p[0], items.index((p[0], y, p[1])))))))
            y += rng.choice([30, 400])
        rows += [(doc, n, w, [(float(x), float(y)), (x + 9.0, y + 10.0)]) for n, (x, y, w) in enumerate(items)]
    df = spark.createDataFrame(rows, f"doc_id int, line_no int, text string, box {BOX}").withColumn("height", F.lit(2200))
    for size in ("7", "40", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = layout.layout_rows(df).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        numbered = {}
        for r in sorted(found, key=lambda r: (r["doc_id"], r["cy"])):
            numbered.setdefault(r["doc_id"], []).append(r)
        assert {(d, i, r["text"]) for d, rs in numbered.items() for i, r in enumerate(rs)} == want
        for rs in numbered.values():  # numbers begin at 0 in every block
            blocks = {}
            for r in rs:
                blocks.setdefault(r["block"], []).append(r["row"])
            assert all(b == list(range(len(b))) for b in blocks.values())


def test_few_rows_are_compared_with_labels(spark, sf_dir):
    from scanweave.plans import recipes

    lines = recipes.labelled_lines(spark, sf_dir).withColumn("height", F.lit(K.PAGE_HEIGHT))
    rows = layout.layout_rows(lines).cache()
    pairs = layout.placed_pairs(rows).where(layout.can_reach())
    assert 0 < pairs.count() < 0.2 * rows.count() * len(layout.PHRASES)
    # the bound is never below the score
    scored = layout.placed_pairs(rows).withColumn("score", layout.phrase_score(
        F.col("normalized_text"), F.col("token_count"), F.col("s.phrase"), F.col("s.n_words")))
    assert scored.where(layout.pair_bound() < F.col("score") - 1e-9).count() == 0
    rows.unpersist()


def test_votes_scan_once(spark, sf_dir):
    from scanweave.plans import recipes

    reads = recipes.name_reads(spark, sf_dir)
    plan = final_plan(consensus.consensus(reads))
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Scan parquet") == 2  # line items and parts
    assert "ReusedExchange" in final or "TableCacheQueryStage" in final


def test_one_account_with_half_of_the_cases(skewed):
    accounts = skewed.range(2000).select((100000000 + F.col("id")).cast("string").alias("account_number"), F.concat(F.lit("H"), F.col("id")).alias("account_holder_name"))
    number = F.when(F.col("id") % 2 == 0, F.lit(100000007)).otherwise(100000000 + F.col("id") % 2500)
    cases = skewed.range(60_000).select(F.col("id").alias("case_id"), F.concat(F.lit("PAY "), number.cast("string"), F.lit(" NOW")).alias("cheque_text"))
    found = cheque.look_up_accounts(cases, accounts)
    assert "skew=true" in final_plan(found)
    assert found.count() == 60_000
    wrong = found.where(~F.col("account_holder_name").eqNullSafe(F.when(
        F.col("account_number").cast("long") < 100002000, F.concat(F.lit("H"), F.col("account_number").cast("long") - 100000000))))
    assert wrong.count() == 0


def test_register(spark, tmp_path):
    rows = [("1", "B", None), ("1", "A", "x"), ("1", "A", "x"), ("2", "C", None), (None, "D", None), ("  ", "E", None), ("3" * 21, "F", None), ("3" * 20, "G", None)]
    accounts = spark.createDataFrame(rows, "account_number string, account_holder_name string, signature_reference_path string")
    register = intake.load_accounts(accounts, str(tmp_path))
    assert {tuple(r) for r in register.collect()} == {("1", "A", "x"), ("2", "C", None), ("3" * 20, "G", None)}
    quarantine = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/quarantine").collect()}
    again, missing = "Account number already registered.", "Missing account number."
    assert quarantine == {("1", "B", None, 1, again), ("1", "A", "x", 1, again), (None, "D", None, 1, missing), ("  ", "E", None, 1, missing),
                          ("3" * 21, "F", None, 1, "Account number too long.")}
    assert intake.duplicate_accounts(register).count() == 0
    register, quarantine = cheque.register_accounts(accounts.limit(0))
    assert register.count() == quarantine.count() == 0


def test_incomplete_cases_keep_a_row(spark):
    accounts = spark.createDataFrame([("123456789", "RAVI KUMAR")], "account_number string, account_holder_name string")
    cases = spark.createDataFrame([(1, "123456789 RAVI KUMAR", "RAVI KUMAR", "RAVI KUMAR"), (2, "x", None, "y"), (3, None, None, None)],
                                  "case_id long, cheque_text string, pan_text string, aadhaar_text string")
    got = {r["case_id"]: (r["final_decision"], r["error"]) for r in cheque.verdicts_or_errors(cases, accounts).collect()}
    assert got == {1: ("Approved", None), 2: (None, "Missing required documents."), 3: (None, "Missing required documents.")}


def test_templates_meet_pages(skewed):
    stored = [("a", "name", 0.0, 0.0, 0.5, 0.5), ("a", "stamp", 0.5, 0.5, 1.0, 1.0), ("b", "name", 0.0, 0.5, 1.0, 1.0), ("b", "dob", 0.25, 0.25, 0.25, 0.75)]
    table = skewed.createDataFrame(stored, "template_id string, field string, x1 double, y1 double, x2 double, y2 double")
    # a has two pages of three
    pages = skewed.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a").when(F.col("id") % 3 == 2, "b").alias("template_id"),
        F.lit(1000).alias("width"), F.lit(2000).alias("height"),
        F.when(F.col("id") % 2 == 0, 1.0).alias("scale"), F.when(F.col("id") % 2 == 0, 100.0).alias("offset"))
    pages = pages.unionByName(skewed.sql("select 5000L doc_id, 'nobody' template_id, 1600 width, 2200 height, double(null) scale, double(null) offset"))
    regions = {(r["doc_id"], r["field"]): (*r["roi"], r["moved"]) for r in templates.page_regions(pages, table).collect()}
    assert regions[1, "name"] == (0, 0, 500, 1000, False) and regions[0, "name"] == (0, 100, 500, 1100, True)
    assert regions[0, "stamp"] == (500, 1100, 1000, 2000, True)
    assert regions[2, "name"] == (0, 1000, 1000, 2000, False)  # moved, the name would lie below the date
    assert regions[5000, "name"] == (512, 605, 1520, 704, False) and len(regions) == 2 * 3000 + 7
    points = [(x, y) for x in (0, 255, 256, 499, 500, 999) for y in (0, 99, 100, 511, 999, 1000, 1099, 1100, 1999, 2500)]
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points]))
    corner = F.struct(F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    lines = pages.select("doc_id", at.alias("p")).withColumn("box", F.array(corner, corner))
    got = {(r["doc_id"], r["p"].x, r["p"].y, r["field"]) for r in templates.assign_by_template(lines, pages, table).collect()}
    docs = [r["doc_id"] for r in pages.select("doc_id").collect()]
    want = {(d, x, y, f) for (d, f), (x1, y1, x2, y2, _) in regions.items() for x, y in points if x1 <= x < x2 and y1 <= y < y2}
    assert got == want and len(docs) == 3001
