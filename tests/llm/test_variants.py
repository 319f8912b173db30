"""Spelling variants against plain edit distances; the table itself is checked against SQL in test_queries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from scanweave.llm import variants
from scanweave.llm.variants import Counts, damaged, near_pairs, near_words, partner_blocks, pieces, spelling_variants, with_roots


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_near(counts):
    """{word: (n_near, best_n, best)} by comparing all words."""
    out = {}
    for w in counts:
        near = [v for v in counts if v != w and one_edit(v, w)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            out[w] = (len(near), counts[best], best)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Chunks and shares so small that every block is dealt out; only where the driver's process cuts them."""
    monkeypatch.setattr(variants, "CHUNKS_PER_TASK", 1)


def test_pairs_of_chunks():
    rng = random.Random(5)
    for length in (5, 6, 9):
        words = sorted({"".join(rng.choice("abcé") for _ in range(length)) for _ in range(60)})
        longer = sorted({"".join(rng.choice("abcé") for _ in range(length + 1)) for _ in range(60)})
        for other in (words, longer):
            a, b = Counts(words, np.ones(len(words))), Counts(other, np.ones(len(other)))
            i, j = near_pairs(a, b)
            assert sorted(zip(i.tolist(), j.tolist())) == [
                (x, y) for x, u in enumerate(words) for y, v in enumerate(other) if one_edit(u, v)]


def test_partner_blocks_reach_every_pair():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 7))) for _ in range(400)}
    key = {w: [len(w), *variants.group_counts(variants.letter_numbers([w], len(w)))[0].tolist()] for w in words}
    for a in words:
        for b in words:
            if a < b and one_edit(a, b):
                met = [variants.block_name(key[y][0], key[y][1:]) in partner_blocks(key[x][0], key[x][1:]) for x, y in ((a, b), (b, a))]
                assert sum(met) == 1 or key[a] == key[b]


def test_dealt_out(spark, small_blocks):
    """One hot block: words of the same letters, cut at 10,000-row batches of Arrow."""
    rng = random.Random(7)
    letters = "abcdefgh"
    words = {}
    while len(words) < 3000:
        words["".join(rng.choice(letters) for _ in range(6))] = rng.randint(3, 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == plain_near(words)


def test_long_words(spark):
    base = "x" * 70_000
    words = {base: 9, base[:-1] + "y": 4, base + "z": 3, "abcde": 3, base[:100]: 5}
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == plain_near(words)


def test_roots_follow_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}" if i < 20 else None, 1 << i) for i in range(21)] + [(f"v{i}", "w003", 1) for i in range(50)]
    got = {r["word"]: r["root"] for r in with_roots(spark.createDataFrame(chain, "word string, form string, n long")).collect()}
    assert got == {w: "w020" for w, _, _ in chain}


def test_damage():
    hit = next(i for i in range(10_000) if zlib.crc32(f"{i}:hello".encode()) % 97 == 0)
    at = zlib.crc32(f"{hit}:hello".encode()) % 5
    assert damaged("HeLLo", zlib.crc32(f"{hit}:".encode())) == "hello"[:at] + "hello"[at + 1:]
    assert damaged("ÉaÀ", zlib.crc32(b"0:")) in {"ÉaÀ", "aÀ", "ÉÀ", "Éa"}
    text = "ab1cd " * 500_000
    assert "".join(pieces(text)) == text and all(not (p[-1].isalpha() and q[:1].isalpha()) for p, q in zip(pieces(text), list(pieces(text))[1:]))


def test_odd_rows(spark):
    rows = [(None, "", 1)] * 2 + [(1, None, 1), (1, "", 1), (2, "colour " * 6 + "color " * 3 + "Colour", 1), (2, "colour", 1), (None, "colouR colonr×", 1), (3, "colonr× colonr× é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(docs).collect()}
    counts = Counter()
    for i, text, _ in rows:
        for run in variants.RUN.findall(text or ""):
            counts[damaged(run, zlib.crc32(f"{'' if i is None else i}:".encode()))] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = plain_near(counts)
    for w, n in counts.items():
        n_near, best_n, best = near.get(w, (0, 0, None))
        form = best if best_n >= 2 * n else None
        assert got[w] == (form, got[w][1], n, n_near, best_n if form else None)
        assert (got[w][1] == w) == (form is None)
    assert set(got) == set(counts) and "colour" in got
    assert spelling_variants(docs.limit(0)).count() == 0
