"""Product codes against plain integers; the table itself is checked against SQL in test_queries."""

import hashlib
import math
import random

import numpy as np
import pytest

from scanweave.llm import product_codes
from scanweave.llm.product_codes import Search, choose_pivots, codebook_text, compress, squared, whole_numbers


def plain(rows):
    """The rounds in Python's integers; rows are (vec_id, vector, label).  {vec_id: (code, error)}, codebooks."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(kept[0][1]) // 8)
    parts = []
    for _, v, _ in kept:
        whole = [math.floor(x) * 4096 if abs(x) >= 2.0**53 else math.floor(4096 * x) for x in v]
        whole += [0] * (8 * width - len(whole))
        parts.append([whole[p * width:(p + 1) * width] for p in range(8)])
    books = [[parts[r][p] for r in range(min(16, len(parts)))] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(6):
        chosen = [[nearest(p, row[p])[1] for row in parts] for p in range(8)]
        for p in range(8):
            new = []
            for j, e in enumerate(books[p]):
                mine = [row[p] for row, c in zip(parts, chosen[p]) if c == j]
                new.append([sum(c) // len(mine) for c in zip(*mine)] if mine else e)
            books[p] = new
    out = []
    for (i, _, label), row in zip(kept, parts):
        found = [nearest(p, row[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{j:02x}" for _, j in found), error if error < 1 << 63 else None))
    return sorted(out, key=repr), books


def rows_of(df):
    return sorted(((r["vec_id"], r["code"], r["error"]) for r in df.collect()), key=repr)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    entries = rng.integers(-5000, 5000, (16, 8))
    entries[7] = entries[3]  # a tie for the lower index
    pivots = entries[choose_pivots(entries)]
    parts = np.vstack([entries[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8)), entries])
    gaps = np.stack([np.sqrt(squared(parts, p[None]).astype(float)) for p in pivots], axis=1).astype(np.float32)
    search = Search(entries.astype(object), pivots)
    index, best = search.nearest(parts, gaps)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert search.evaluated < 0.5 * every.size


@pytest.mark.parametrize("dimension, n, scale", [(16, 300, 1.0), (11, 40, 0.5), (8, 7, 1.0), (64, 60, 1e6), (16, 30, 1e30)])
def test_against_integers(spark, dimension, n, scale):
    rng = random.Random(dimension + n)
    rows = [(rng.randrange(n), [rng.gauss(0, 1) * scale for _ in range(dimension)], rng.choice([None, 1, 2])) for _ in range(n)]
    rows += [(None, [scale * 0.25] * dimension, 1)] * 2
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, code int")
    coded, books = compress(df)
    expected, plain_books = plain(rows)
    assert rows_of(coded) == expected
    assert codebook_text(books) == ",".join(str(v) for p in plain_books for e in p for v in e)


def test_numbers():
    values = np.array([0.5, -0.1, 1023.99, -1e300, 2.0**53 + 2, 1e-320, -1e-320])
    assert whole_numbers(values).tolist() == [math.floor(v) * 4096 if abs(v) >= 2.0**53 else math.floor(4096 * v) for v in values.tolist()]
    assert whole_numbers(np.float32([0.1])).tolist() == [math.floor(4096 * float(np.float32(0.1)))]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [float(i) for i in range(8)]
    rows = [(1, None, 1), (2, good[:7] + [None], 1), (3, good[:7] + [nan], 1), (4, good[:7] + [-inf], 1), (5, good, None), (5, good, None),
            (6, good[:5], 1), (7, good, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r)[:4] for r in product_codes.product_codes(df).collect())
    # three equal vectors: entry 0 is the nearest of equal ones
    assert got == [(5, "00" * 8, 0, 0), (5, "00" * 8, 0, 0), (7, "00" * 8, 0, 0)]
    assert product_codes.product_codes(df.limit(0)).count() == 0
    assert product_codes.product_codes(df.where("vec_id < 5")).count() == 0
    empty = spark.createDataFrame([(1, [], 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [r["error"] for r in product_codes.product_codes(empty).collect()] == [0, 0]


def test_label_errors(spark, monkeypatch):
    rows = [(i, "", None if i % 5 == 0 else i % 3, i) for i in range(100)] + [(100, "", 9, None), (101, "", 9, 4), (102, "", 8, 2**62), (103, "", 8, 2**62)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, label int, error long")
    sums = {}
    for _, _, label, e in rows:
        sums.setdefault(label, []).append(e)
    expected = {k: None if None in v or sum(v) >= 2**63 else sum(v) for k, v in sums.items()}
    for limit in (100_000, 2):  # broadcast, and dealt out with salt
        monkeypatch.setattr(product_codes, "LABELS", limit)
        got = product_codes.with_label_errors(coded).collect()
        assert len(got) == len(rows) and all(r["label_error"] == expected[r["label"]] for r in got)


def test_codebook_text():
    assert hashlib.sha256(codebook_text([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert codebook_text([np.array([[1, -2], [3, 4]], object), np.array([[5, 6]], object)]) == "1,-2,3,4,5,6"
