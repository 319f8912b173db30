"""Each stage against a brute-force reading of its rule, on what the stage before it left."""

import corpus_pipeline as P
from scanweave.llm import outliers, toxicity
from scanweave.llm.shared import settle
from tests.llm import test_bpe, test_decontaminate, test_ngram_join

SF = "/root/testdata/sf0.01"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    left = {}
    for name, stage in P.STAGES:
        before = docs
        docs = settle(stage(spark, docs, SF))
        left[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.schema == before.schema

    before, after = left["toxicity"]
    clean = {r.doc_id for r in toxicity.toxicity_scores(before, labels).where("predicted = 0").collect()}
    assert {i for i, _ in rows(after)} == clean and after.count() == len(clean)
    before, after = left["quality_rules"]
    assert {i for i, _ in rows(after)} == {r.doc_id for r in outliers.quality_rules(before).where("kept").collect()}
    before, after = left["ngram_jaccard_join"]
    assert sorted(i for i, _ in rows(after)) == sorted({r[2] for r in test_ngram_join.brute(rows(before))})
    before, after = left["benchmark_decontamination"]
    bad = {r[0] for r in test_decontaminate.brute(rows(before), rows(items.withColumnRenamed("item_id", "doc_id"))) if r[5]}
    assert bad and sorted(i for i, _ in rows(after)) == sorted(i for i, _ in rows(before) if i not in bad)
    before, after = left["bpe_encoding"]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()]
    assert sorted(got, key=repr) == test_bpe.brute(rows(before))


def test_edges(spark, tmp_path):
    """NULLs, empty texts, repeated rows, an empty table, extra columns."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _row int, score double"
    text = " ".join(f"word{i}" for i in range(80))
    table = [(1, text, "en", None, 1, 1, 0.5), (1, text, "en", None, 1, 1, 0.5), (2, None, None, "s", None, 2, None), (3, "", "en", "s", 0, 3, 1.0), (None, text + " more", "en", "s", 4, 4, 1.0),
             (4, text + " idiot moron scum stupid loser", "en", "s", 5, 5, 1.0)]
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for k, data in enumerate((table, [])):
        docs = spark.createDataFrame(data, kinds)
        for name, stage in P.STAGES[:4]:
            docs = settle(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [x.split(" ")[0] for x in kinds.split(", ")]
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 1] if k == 0 else [])
        assert P.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()
