import numpy as np
import pyarrow as pa

from scanweave.llm import neighbours as N


def test_votes_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    space = N.fit(docs, labels)
    rows = docs.orderBy("doc_id").limit(50).collect()
    x = N.features(pa.array([r.text for r in rows]))
    for i, got in enumerate(space.vote(x)):
        v = x[i] @ space.directions
        c = [(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), k) for k, w in enumerate(space.vectors)]
        near = sorted(c, reverse=True)[: N.NEIGHBOURS]
        weight = [max(0, s) ** N.SHARPNESS * space.weight[k] for s, k in near]
        assert abs(got - sum(w * space.y[k] for w, (_, k) in zip(weight, near)) / sum(weight)) < 1e-3


def test_held_out_accuracy(spark):
    for sf, least in (("sf0.01", 0.9), ("sf0.1", 0.95)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        rows = N.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").groupBy("quality", "predicted").count().collect()
        n = {(r.quality, r.predicted): r["count"] for r in rows}
        for q in (0, 1):
            assert n[q, q] / (n[q, q] + n.get((q, 1 - q), 0)) > least, n


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "some words here"), (3, "x"), (4, "word " * 50000), (5, "é\n\n!!")]
    docs = spark.createDataFrame([(i, t, "en", 1.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    some = spark.createDataFrame([(3, 0, None), (4, 1, None), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        got = N.quality_scores(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert N.quality_scores(docs.limit(0), some).count() == 0
