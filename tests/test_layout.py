import random

from pyspark.sql import functions as F

from scanweave.operators import layout, refine

LINES = "doc_id long, read_id long, line_no int, text string, score double, box array<struct<x:double,y:double>>"


def line(doc, n, text, x1, y1, x2, y2):
    corners = None if x1 is None else [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    return (doc, doc, n, text, 0.95, corners)


GOOD = [
    ("LAST NAME / SURNAME", 90, 628, 360, 660), ("GENDER", 70, 1038, 220, 1070), ("DATE OF BIRTH", 70, 1160, 340, 1192),
    ("LAST NAME / SURNAME", 90, 1374, 360, 1406), ("MOTHER'S NAME", 70, 1640, 320, 1672),
    ("RESIDENCE ADDRESS", 70, 1750, 360, 1782), ("STATE / UNION TERRITORY", 70, 2084, 420, 2116),
]
NOISY = [
    ("LAST NAME / SURNAME", 90, 520, 360, 552), ("GENDER", 70, 1030, 220, 1062), ("DATE OF BIRTH", 70, 1140, 340, 1172),
    ("RESIDENCE ADDRESS", 70, 1860, 360, 1892),
    ("RAND/STSET/LARA PART OTICE ARCALCCAIRYTEHTICNSOIRDTTON TOVNCIYCTORRIC SRETEURON TERRTCRY KARNATAA", 70, 1960, 1420, 2050),
]


def test_labels_move_the_regions_and_noise_does_not(spark):
    rows = [line(1, i, *b) for i, b in enumerate(GOOD)] + [line(2, i, *b) for i, b in enumerate(NOISY)]
    pages = spark.createDataFrame([(1,), (2,)], "doc_id long")
    df = spark.createDataFrame(rows, LINES)
    got = {r["doc_id"]: r for r in layout.page_rois(pages, df, df).collect()}
    assert got[1]["dynamic"] and not got[2]["dynamic"]
    rois = {e["field"]: e["roi"] for e in got[1]["rois"]}
    assert set(rois) == {"name", "dob", "gender", "father_name", "address", "state", "pin"}
    assert rois["name"].y1 < rois["gender"].y1 and rois["dob"].y1 > 1172
    assert rois["father_name"].y1 > rois["dob"].y1 and rois["address"].y2 <= rois["state"].y1
    assert rois["pin"].x1 > rois["state"].x1
    fixed = {e["field"]: tuple(e["roi"]) for e in got[2]["rois"]}
    assert fixed["name"] == (512, 605, 1520, 704)


def test_blocks_give_the_rows_of_a_plain_fold(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for doc in range(12):
        crowded = doc % 3 == 0
        items = []
        for n in range(120):
            y = rng.randrange(0, 900 if crowded else 6000)
            x = rng.randrange(0, 1500)
            h = rng.choice([8, 14, 22, 60])
            items.append((f"W{n}", x, y, x + 40, y + h))
        rows += [line(doc, n, *i) for n, i in enumerate(items)]
        ordered = sorted((((y1 + y2) / 2, x1, n), t, x1, y1, x2, y2) for n, (t, x1, y1, x2, y2) in enumerate(items))
        groups = []
        for (cy, _, n), t, x1, y1, x2, y2 in ordered:
            if groups and abs(cy - (groups[-1]["lo"] + groups[-1]["hi"]) / 2) <= 17:
                g = groups[-1]
                g["lo"], g["hi"] = min(g["lo"], y1), max(g["hi"], y2)
                g["words"].append((x1, cy, n, t))
            else:
                groups.append({"lo": y1, "hi": y2, "words": [(x1, cy, n, t)]})
        want |= {(doc, " ".join(w[3] for w in sorted(g["words"])), g["lo"], g["hi"]) for g in groups}
    df = spark.createDataFrame(rows, LINES).withColumn("height", F.lit(2200))
    got = {(r["doc_id"], r["text"], r["y1"], r["y2"]) for r in layout.layout_rows(df).collect()}
    assert got == want


def test_lines_go_to_their_region(spark):
    df = spark.createDataFrame([line(1, 0, "RAVI", 600, 620, 700, 650), line(1, 1, "ELSEWHERE", 0, 0, 10, 10), line(1, 2, "NO BOX", None, 0, 0, 0)], LINES)
    assert [(r["text"], r["field"]) for r in layout.assign_fields(df).collect()] == [("RAVI", "name")]
    rois = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.expr(
        "array(struct('pin' as field, struct(0 as x1, 0 as y1, 20 as x2, 20 as y2) as roi))").alias("rois"))
    assert [(r["text"], r["field"]) for r in layout.assign_fields(df, rois).collect()] == [("ELSEWHERE", "pin")]


def refined(spark, read):
    """Candidate regions of one base region, each read by ``read(width)``."""
    base = (80, 80, 160, 120)
    roi = "roi struct<x1:int,y1:int,x2:int,y2:int>"
    schema = f"doc_id long, field string, roi_ordinal int, {roi}, base_{roi}, raw_text string, clean_text string, confidence double"
    first = spark.createDataFrame([(1, "name", -1, base, base, *read(80))], schema)
    leaked = refine.with_leakage(first)
    offered = refine.refinement_candidates(leaked.drop("base_roi", "roi_ordinal"), 240, 240).collect()
    rows = [(1, "name", r["roi_ordinal"], tuple(r["roi"]), base, *read(r["roi"].x2 - r["roi"].x1)) for r in offered]
    results = first.unionByName(spark.createDataFrame(rows, schema)) if rows else first
    return refine.best_refinement(refine.with_leakage(results)).collect()[0], offered


def test_a_weak_read_takes_a_wider_region(spark):
    best, offered = refined(spark, lambda w: ("NARASEMHAPPA", "NARASEMHAPPA", 0.55 if w <= 80 else 0.93))
    assert best["roi"].x2 - best["roi"].x1 > 80 and best["confidence"] > 0.9
    assert len(offered) == 12


def test_a_leaked_label_takes_a_narrower_region(spark):
    best, _ = refined(spark, lambda w: ("LAST NAME NARASEMHAPPA", "NARASEMHAPPA", 0.92) if w >= 80 else ("NARASEMHAPPA", "NARASEMHAPPA", 0.90))
    assert best["roi"].x2 - best["roi"].x1 < 80 and best["raw_text"] == "NARASEMHAPPA"


def test_a_good_read_stays(spark):
    best, offered = refined(spark, lambda w: ("NARASEMHAPPA", "NARASEMHAPPA", 0.95))
    assert offered == [] and tuple(best["roi"]) == (80, 80, 160, 120)


def test_a_field_outside_the_order_does_not_undo_the_layout(spark):
    from scanweave.functions import geometry as g

    known = spark.range(1).select(g.template_rois().alias("t"))
    low = F.col("t")[0].withField("field", F.lit("signature")).withField("y1", F.lit(0.97)).withField("y2", F.lit(0.99))
    moved = g.shifted_rois(F.lit(1600), F.lit(2200), F.lit(1.0), F.lit(0.0), F.concat("t", F.array(low)))
    assert known.select(F.size(moved).alias("n")).first().n == len(g.K.DEFAULT_ROIS) + 1


def test_lines_of_a_union_meet_on_their_page(spark, tmp_path):
    from scanweave.plans import recipes
    from scanweave.shipping import ship

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.concat(F.lit("LINE "), i.cast("string"))), "\n")
    spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ship(spark)
    lines = recipes.labelled_lines(spark, str(tmp_path)).withColumn("height", F.lit(2200))
    lines.write.parquet(f"{tmp_path}/lines.parquet")

    def rows(of):
        return {tuple(r) for r in layout.layout_rows(of).drop("block", "row").collect()}

    assert rows(lines) == rows(spark.read.parquet(f"{tmp_path}/lines.parquet"))


def test_nothing_that_grows_with_the_pages_is_broadcast(spark, sf_dir):
    from scanweave.plans.catalogue import QUERIES

    df = QUERIES["page_regions"](spark, sf_dir)
    assert df.count() and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
