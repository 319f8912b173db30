import re
from collections import defaultdict

import pytest

from scanweave.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders, near = defaultdict(list), defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]} - {i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                near[i].add(j)
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for k in near[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[i][0], len(sets[i]), seen[i], len(near[i])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "n_links")) for r in df.collect()), key=repr)


def family(base, count, step, words):
    out = []
    for k in range(count):
        w = [f"w{base}x{i}" for i in range(words)]
        for j in range(k % step):
            w[(j * 7 + k) % words] = f"e{k}y{j}"
        out.append(" ".join(w))
    return out


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    texts = [None, "", "  \n", "one two", "One  TWO", "two one", "a b c d e", "a b c d e", "a b c d e f", long, long + " end", "É b c d e", "é b c d e"]
    texts += family(1, 9, 4, 60) + family(2, 40, 6, 90) + ["x " * 50, "x " * 70]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, "a b c d e"), (None, "a b c d e"), (None, "lonely words here")]
    df = spark.createDataFrame([(i, t, "c", 1, b"q") for i, t in rows], "doc_id long, text string, cls string, family int, items binary")
    assert got(J.ngram_links(df)) == brute(rows)
    assert J.ngram_links(df.where("doc_id < 0")).count() == 0


def test_blocks(spark, monkeypatch):
    rows = [(1000 - i, t) for i, t in enumerate(family(3, 60, 5, 80))]
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    assert got(J.ngram_links(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert got(J.ngram_links(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words in this one here"), (None, "a b c d e f"), (4, None)]
    left = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)
