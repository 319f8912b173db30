import math
import re
from collections import Counter

import pytest

from scanweave.llm import ngram_lm as L


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, kept=None):
    texts = [words(t) for _, t in rows]
    uni = Counter(w for t in texts for w in t)
    total = sum(uni.values())
    name = (lambda w: w) if kept is None else (lambda w: w if w in kept else None)
    count = Counter(name(w) for t in texts for w in t)
    count["<s>", ] = sum(1 for t in texts if t)
    seq = [[("<s>",), *map(name, t)] for t in texts]
    pairs = Counter(p for s in seq for p in zip(s, s[1:]))
    out = []
    for (i, _), s in zip(rows, seq):
        score = sum(min(0, math.log(pairs[a, b] / count[a])) if pairs[a, b] >= 2 else math.log(0.4 * count[b] / total) for a, b in zip(s, s[1:]))
        out.append((i, len(s) - 1, score))
    return sorted(out, key=repr)


def check(df, expected):
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in df.collect()), key=lambda r: repr(r[:2]))
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected, key=lambda r: repr(r[:2]))]
    assert sorted((str(g[:2]), g[2]) for g in got) == [(k, pytest.approx(v, abs=1e-4)) for k, v in sorted((str(e[:2]), e[2]) for e in expected)]


def test_cases(spark):
    texts = [None, "", " \n", "a b c", "A b", "a b c d", "x", "w " * 20000, "é à b c", "a b c"]
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "q r s")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, keys binary")
    check(L.lm_scores(df), brute(rows))
    assert L.lm_scores(df.limit(0)).count() == 0
    assert L.lm_scores(df).where("n_words = 0 and (mean_log_score is not null or log_score != 0)").count() == 0


def test_bounded_vocabulary(spark):
    rows = [(0, "a a a a b b b c d"), (1, "a b c a b")]
    check(L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), 2), brute(rows, {"a", "b"}))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(L.lm_scores(df), brute([(r.doc_id, r.text) for r in df.collect()]))


def test_rare_words_count_as_themselves(spark):
    """More distinct words than have numbers: none of them is merged with another."""
    n = L.NUMBERED + 20_000
    texts = [" ".join(f"w{i}" for i in range(a, min(a + 2000, n))) for a in range(0, n, 2000)]
    rows = list(enumerate(texts + ["w1 w2 w1 w2 w7", "w150000 zz w150000 zz", "the the the w9", "w1 w2 w150000"]))
    check(L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), brute(rows))


def test_hashed_beside_numbered(spark, monkeypatch):
    """Bigrams of words with and without a number, seen once and more often."""
    monkeypatch.setattr(L, "NUMBERED", 3)
    rows = [(0, "a a a a b b b c d a d a c d"), (1, "a b c a b c d e"), (None, "e a"), (1, "x e a x"), (2, ""), (3, "f")]
    check(L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows))
