import re
from collections import Counter

import numpy as np
import pyarrow as pa

from scanweave.llm import outliers as O

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, inside = Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics(spark):
    texts = [None, "", " \n \n", "a b c a b c", "x\nx\nx \n\n", "é# <b> $%&|*\né# <b> $%&|*", "one two", "w " * 60, " ".join(f"w{i}" for i in range(40000)), "a a a a b"]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(1, "again", "en", None), (None, "x " * 9, "en", "s")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    got = sorted([(r.doc_id, *(r[c] for c in COLUMNS)) for r in O.quality_rules(docs).collect()], key=repr)
    assert got == sorted([(r[0], *base(r[1])) for r in rows], key=repr)
    assert O.quality_rules(docs.limit(0)).count() == 0
    assert {r.kept for r in O.quality_rules(docs).where("doc_id = 8").collect()} == {True}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = O.quality_rules(docs)
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted((r.doc_id, *base(r.text)) for r in docs.collect())
    good = got.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in good}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0
    assert O.without_outliers(docs).count() == got.where("kept").count()


def test_estimate_against_brute_force(spark):
    """Concentration steps in numpy reach the same centre and shape."""
    rng = np.random.default_rng(5)
    good = rng.normal([1.6, 0.2, 0.1, 0.3], [0.1, 0.2, 0.2, 0.3], (900, 4))
    bad = rng.normal([3, 2, 1, 0.9], 0.05, (150, 4))
    x = np.floor(np.concatenate([good, bad]) * O._UNIT + 0.5).astype(int)
    rows = spark.createDataFrame([("a", *map(int, r)) for r in x], "g string, f0 long, f1 long, f2 long, f3 long")
    shape = O.shapes(rows).collect()[0]
    v, floor = x / O._UNIT, np.diag(np.square(O.FLOOR))
    centre = np.median(v, 0)
    inverse = np.diag(1 / ((1.4826 * np.median(abs(v - centre), 0)) ** 2 + np.square(O.FLOOR)))
    for _ in range(O.STEPS):
        d = np.einsum("ij,jk,ik->i", v - centre, inverse, v - centre)
        near = v[d <= np.quantile(d, O.SHARE)]
        centre, inverse = near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) * O.SPREAD + floor)
    assert np.allclose([shape[f"m{i}"] for i in range(4)], centre, atol=0.01)
    assert np.allclose(np.array(shape.inv).reshape(4, 4), inverse, rtol=0.1, atol=1)
    d = np.einsum("ij,jk,ik->i", v - centre, inverse, v - centre)
    assert (d[900:] > O.LIMIT).all() and (d[:900] < O.LIMIT).all()


def test_more_words_than_21_bits():
    """Windows of a text with over 2**21 distinct words are told apart."""
    n = (1 << 21) + 8
    text = " ".join(map(str, range(n))) + f" 5 0 {n - 1} 5 1 7 3 4 5 6"
    out = list(O._statistics(("doc_id",))([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))[0]
    assert out.column("n_words")[0].as_py() == n + 10
    assert out.column("n_repeat_words")[0].as_py() == 8  # 3 4 5 6, here and there


def test_small_groups(spark):
    """Rows of small groups are judged by their language or by the whole table."""
    rng = np.random.default_rng(3)
    prose = lambda: " ".join("w" + "abcdefghij"[: k] + str(i) for i, k in enumerate(rng.integers(1, 8, 80)))
    junk = " ".join(f"#${i}&<|>*%" * 3 for i in range(80))
    rows = [(i, prose(), "en", "big") for i in range(120)] + [(200, prose(), "en", "small"), (201, junk, "en", "small")]
    rows += [(300, prose(), "xx", "small"), (301, junk, "xx", None), (302, "short", "yy", None)]
    got = {r.doc_id: r for r in O.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all((r.d2 is None) == (i == 302) for i, r in got.items())
    assert [i for i in sorted(got) if not got[i].kept] == [201, 301, 302]
