"""What the larger jobs leave on disk on their way."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave.functions.geometry import EDGES, packed_roi, unpacked_edges
from scanweave.operators import address, layout, refine
from scanweave.plans import recipes
from scanweave.sources.shared import discard, settle


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_settled_rows_leave_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    kept = settle(rows)
    assert shuffle_files(spark) <= before
    assert sorted(kept.collect()) == sorted(rows.collect())


def test_rounds_write_one_row_per_field_and_the_reads_that_win(spark, sf_dir):
    regions = recipes.base_regions(spark, sf_dir).select("doc_id", "field", "roi").where("doc_id % 50 = 0")
    # some keys repeat, some are missing
    regions = regions.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 2000))
    base, kept, gone = recipes.stand_in_reads(regions), [], []

    def noted(df):
        kept.append((settle(df), df.count()))
        return kept[-1][0]

    found = refine.refine_rounds(base, recipes.stand_in_reads, noted, discard=lambda t: (gone.append(t), discard(t)))
    leaked = refine.with_leakage(base)
    every = refine.refinement_candidates(leaked).select("doc_id", "field", "roi_ordinal", "roi", "base_roi")
    known = leaked.withColumns({"roi_ordinal": F.lit(-1), "base_roi": F.col("roi")})
    reads = refine.with_leakage(recipes.stand_in_reads(every))
    want = refine.best_refinement(known.select(reads.columns).unionByName(reads))
    # copies of a field may tie, so the scores are compared
    assert {(r["doc_id"], r["field"], r["score"]) for r in found.collect()} == {(r["doc_id"], r["field"], r["score"]) for r in want.collect()}
    assert found.count() == want.count() and found.where("doc_id is null").count()
    n_weak = kept[0][0].where("weak").count()
    between, won = [x for x in kept if "best" in x[0].columns], [x for x in kept[1:] if "raw_text" in x[0].columns]
    assert between and sum(n for _, n in between) == n_weak * len(between) / refine.PARTS
    assert won and sum(n for _, n in won) < 0.6 * every.count()
    assert not any(isinstance(f.dataType, T.ArrayType) for t, _ in kept for f in t.schema)
    assert len(gone) == len(kept) - 1 - refine.PARTS  # the base and the last rows per field are asked for by the result


def shuffles(df):
    """Exchanges of the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_lines_of_pages_are_shuffled_once(spark, sf_dir):
    lines = recipes.labelled_lines(spark, sf_dir).withColumn("height", F.lit(2200))
    rows = layout.layout_rows(lines)
    assert shuffles(rows) - shuffles(lines) == 1
    anchors = layout.match_anchors(rows)
    assert shuffles(anchors) - shuffles(rows) == 1
    # what is worked out page by page stays where the pairs are
    assert shuffles(layout.fit_pages(anchors)) == shuffles(anchors)


def test_regions_of_any_size_come_back_from_a_shuffle(spark):
    rows = [(0, 0, 65535, 1), (70, 639, 340, 671), (-1, 5, 10, 20), (1, 2, 65536, 4), (2147483647, -2147483648, 0, 0), (None, 1, 2, 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int")
    packed = df.select("*", packed_roi([F.col(e) for e in EDGES]).alias("b"))
    assert [tuple(r) for r in packed.select(*unpacked_edges(F.col("b"))).collect()] == rows
    assert [r[0] for r in packed.select(F.col("b.short").isNotNull() & F.col("b.wide").isNull()).collect()] == [True, True] + [False] * 5


def test_a_crowded_page_is_cut_and_others_are_not(spark, monkeypatch):
    monkeypatch.setattr(layout, "CROWDED", 50)
    x, y = (F.col("n") % 3) * 100.0, F.floor(F.col("n") / 3) * 60.0 + F.col("n") % 5
    box = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (80, 18))])
    lines = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).alias("doc_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") == 1, 120).otherwise(40))).alias("n")).select(
        "doc_id", F.col("n").alias("line_no"), F.concat(F.lit("W"), F.col("n").cast("string")).alias("text"), box.alias("box"), F.lit(2200).alias("height"))
    rows = layout.layout_rows(lines).collect()
    assert {r["doc_id"] for r in rows} == {0, 1}  # a line without a page is on none
    assert {r["block"] for r in rows if r["doc_id"] == 0} == {0} and len({r["block"] for r in rows if r["doc_id"] == 1}) > 9
    for doc, last in ((0, 40), (1, 120)):
        texts = [r["text"] for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["cy"])]
        assert texts == [" ".join(f"W{n}" for n in range(i, min(i + 3, last + 1))) for i in range(0, last + 1, 3)]


def line_reads(spark):
    doc, n = F.col("id") % 9, F.col("id")
    return spark.range(400).select(
        F.when(doc > 0, doc).alias("doc_id"), (n % 4).cast("int").alias("line_idx"), n.alias("ordinal"),
        F.when(n % 2 == 0, "base").otherwise("prepared").alias("variant"),
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("MAIN R"), F.substring(F.lit("OAEIUX"), (n * 5 % 11 % 6 + 1).cast("int"), F.lit(1)), F.lit("AD "), (n % 5 + 10).cast("string"))).alias("raw_text"),
        (n * 7 % 64 / 64.0).alias("confidence"))


def test_line_windows_are_decided_where_their_reads_are(spark):
    spread = line_reads(spark).repartition(8, "doc_id")
    # the lines of a document are put together; nothing else moves, nor do reads that come spread by document
    assert shuffles(address.address_vote(spread)) - shuffles(spread) == 1
    assert shuffles(address.address_vote(line_reads(spark))) == 2


def test_windows_of_many_reads_are_decided_alike(spark, monkeypatch):
    few = {tuple(map(str, r)) for r in address.address_vote(line_reads(spark)).collect()}
    assert len(few) == 9  # one is the reads without a document
    for most in (0, 10):  # all go by tiles, or some
        monkeypatch.setattr(address, "FEW", most)
        assert {tuple(map(str, r)) for r in address.address_vote(line_reads(spark)).collect()} == few
