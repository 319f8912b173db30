import pytest
from pyspark.sql import functions as F

from scanweave.llm import toxicity as T


def test_fold():
    cyrillic = "".join(map(chr, (0x456, 0x501, 0x456, 0x43E, 0x442)))
    wide = "".join(chr(0xFF21 + ord(c) - 65) for c in "IDIOT")
    hidden = "i" + chr(0xAD) + "di" + chr(0x200B) + "ot"
    assert T.fold(f"IDI0T, 1diot! {cyrillic} {wide} {hidden}") == " idiot idiot idiot idiot idiot "
    assert T.fold("") == "  " and T.fold("$tup1d café") == " stupid café "
    assert T.fold("WORD!! id!ot |") == " word idiot "


def test_matching():
    m = T.Matcher({" idiot ": 3.0, " scum ": 2.0, " vequ": 4.0, " vequa": 5.0}, ("pond scum",))
    folded = T.fold("an idiot idiotic pond scum, scum vequation")
    assert sorted(m.spans(folded).values()) == [2.0, 3.0, 5.0]
    assert m.raw("an idiot") > m.raw("an idiot " + "word " * 5000) > m.raw("clean") == 0


def brute(weights, exceptions, text):
    words = T.fold(text).split()
    free = set()
    for e in exceptions:
        p = T.fold(e).split()
        free |= {i + k for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(len(p))}
    total = 0
    for i, w in enumerate(words):
        best = max([v for t, v in weights.items() if t.strip() == w or (not t.endswith(" ") and w.startswith(t[1:]))], default=0)
        total += best * (i not in free)
    return total / T.math.log2(8 + (len(words) + 1) / 100) if total else 0.0


def test_scores_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = T.learn_lexicon(T.training_sample(docs, labels, "toxic", T.SAMPLE_PER_CLASS).select("text", "y"))
    m = T.Matcher(weights)
    for r in docs.orderBy(F.xxhash64("doc_id")).limit(300).collect():
        assert m.raw(r.text) == pytest.approx(brute(weights, T.EXCEPTIONS, r.text))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.98


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you idiot, you moron, you scum"), (3, "you idiot, you moron, you scum"), (None, "fine words"), (4, "word " * 50000)]
    docs = spark.createDataFrame([(i, t, "en", 2.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got} == {1: 0, 2: 0, 3: 1, None: 0, 4: 0}
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0
    assert sorted((r.doc_id or 0) for r in T.without_toxic(docs, labels).collect()) == [0, 1, 2, 4]
