import hashlib
import re

import pytest

from scanweave.llm import decontaminate as D


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    windows = set()
    for item_id, text in items:
        w = tokens(text)
        windows |= {(tuple(w[i : i + width]), "" if item_id is None else str(item_id)) for i in range(max(1, len(w) - width + 1)) if w}
    by = {}
    for w, i in windows:
        by.setdefault(w, set()).add(i)
    sizes = {len(w) for w in by}
    out = []
    for doc_id, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := by.get(tuple(w[i : i + n])):
                    ids |= got
                    hit |= set(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


LONG = " ".join(f"q{i % 97}" for i in range(200))
ITEMS = [(1, "the the the the the the the the the the the the"), (2, "one Two, three"), (3, None), (4, ""), (5, LONG), (6, LONG), (10, "..!"), (None, "null item words"), (7, "É élan x")]
DOCS = [(1, "the " * 25), (2, "xx one two three yy. One-two THREE"), (3, None), (4, ""), (5, "a " * 50 + LONG[90:400] + " b" * 3), (6, LONG + " " + LONG),
        (7, "the " * 9), (8, "null item words É élan x"), (9, "é élan x"), (None, "one two three"), (None, "nothing"), (2, "clean row"), (11, "w " * 40000 + "one two three")]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in DOCS], "doc_id long, text string, term string, item int")
    items = spark.createDataFrame(ITEMS + ITEMS[:2], "item_id long, text string")
    assert got(D.contamination(docs, items)) == brute(DOCS, ITEMS)
    assert got(D.contamination(docs, items.limit(0))) == brute(DOCS, [])
    assert D.contamination(docs.limit(0), items).count() == 0
    kept = {(r.doc_id, r.text) for r in D.without_contaminated(docs, items).collect()}
    assert kept == {d for d, b in zip(sorted(DOCS, key=repr), sorted(((x, t) for x, t in DOCS), key=repr)) if not brute([d], ITEMS)[0][5]}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zz three one foo two yy"), (2, "one far far far far far two three")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    assert {r.doc_id for r in D.near_matches(docs, items, 3).collect()} == {1}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = got(D.contamination(docs, items))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[5] for r in found)
