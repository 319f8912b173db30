import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from scanweave.operators import address, consensus, dob

READS = "doc_id long, field string, ordinal long, raw_text string, clean_text string, confidence double"
NAMES = ["NARASEMHAPPA", "NARASEMHAPA", "NARASIMHAPPA", "GANGAPPA", "GANGHPPA", "CANGAPPA", "RAVI", "RAVI KUMAR", "RAVIKUMAR"]


def similarity_winner(reads):
    """Direct reading of the rule, all reads of one group in memory."""
    def vote(r):
        return round(sum(SequenceMatcher(None, r["c"], o["c"]).ratio() * o["conf"] for o in reads), 9)

    return max(reads, key=lambda r: (vote(r), r["conf"], -len(r["c"]), -r["o"]))


def make_names(groups, size, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(groups):
        seen = set()
        while len(seen) < size(rng):
            base = list(rng.choice(NAMES))
            base[rng.randrange(len(base))] = rng.choice("AEIOXZ")
            seen.add("".join(base))
        rows += [(d, "name", i, f"raw {t}", t, rng.randrange(64) / 64) for i, t in enumerate(sorted(seen, key=lambda _: rng.random()))]
    return rows


def check_names(spark, rows):
    df = spark.createDataFrame(rows, READS).repartition(5)
    got = {r["doc_id"]: (r["raw_text"], r["clean_text"], r["confidence"]) for r in consensus.consensus(df).collect()}
    by_doc = {}
    for d, _, o, raw, c, conf in rows:
        by_doc.setdefault(d, []).append({"o": o, "raw": raw, "c": c, "conf": conf})
    want = {d: (w["raw"], w["c"], w["conf"]) for d, w in ((d, similarity_winner(rs)) for d, rs in by_doc.items())}
    assert got == want


def test_name_votes(spark):
    check_names(spark, make_names(60, lambda r: r.randint(1, 6), 1))


def test_name_votes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(consensus, "CHUNK", 4)
    check_names(spark, make_names(6, lambda r: 23, 2))


def test_a_hot_group_is_decided_whole(spark):
    # One document holds nearly all reads, and all of its texts differ.
    check_names(spark, make_names(1, lambda r: 300, 3) + [(d + 10, *r[1:]) for d in range(5) for r in make_names(1, lambda r: 3, d)])


def test_consensus_rules(spark):
    rows = [
        (1, "pin", 0, "a", "560001", 0.5), (1, "pin", 1, "b", "560001", 0.5), (1, "pin", 2, "c", "560002", 0.9),
        (2, "pin", 0, "x", "", 0.2), (2, "pin", 1, "y", "", 0.7), (2, "pin", 2, "z", "", 0.7),
        (3, "pin", 0, "", "111111", 0.25), (3, "pin", 1, "q", "222222", 0.25),
        (4, "name", 0, "RAVI", "RAVI", 0.5), (4, "name", 1, "", "", 0.9),
        (5, "name", 0, "A", "ANNA", 0.5), (5, "name", 1, "B", "ANNA", 0.75), (5, "name", 2, "C", "HANNAH", 1.0),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r["doc_id"]: tuple(r)[2:] for r in consensus.consensus(spark.createDataFrame(rows, READS)).collect()}
        assert got == {
            1: ("b", "560001", 0.5),  # most support, last of the equally confident raw texts
            2: ("y", "", 0.7),        # nothing cleaned: first of the most confident
            3: ("111111", "111111", 0.25),  # full tie: first seen, and an empty raw text shows the clean one
            4: ("RAVI", "RAVI", 0.5),
            5: ("B", "ANNA", 0.625),
        }


def test_address_lines(spark):
    rng = random.Random(5)
    rows = []
    for d in range(40):
        for w in range(5):
            street = rng.choice(["MAIN ROAD", "HIGH STREET", "OLD MARKET", "A B STREET"])
            for i, variant in enumerate(["base", "base", "prepared", "prepared"]):
                t = list(street)
                if rng.random() < 0.6:
                    t[rng.randrange(len(t))] = "X"
                rows.append((d, w, w * 4 + i, variant, "" if rng.random() < 0.2 or d % 7 == 0 else "".join(t), rng.randrange(64) / 64))
    df = spark.createDataFrame(rows, "doc_id long, line_idx int, ordinal long, variant string, raw_text string, confidence double")
    clean = {(r["doc_id"], r["ordinal"]): r["clean_text"] for r in address.line_candidates(df).collect()}
    got = {r["doc_id"]: r for r in address.address_vote(df).collect()}
    for d in range(40):
        winners = []
        for w in range(5):
            group = [{"o": o, "raw": raw, "c": clean[d, o], "conf": conf + (0.03 if v == "prepared" else 0.0)}
                     for dd, ww, o, v, raw, conf in rows if (dd, ww) == (d, w) and (d, o) in clean]
            if group:
                def rank(r):
                    vote = round(sum(SequenceMatcher(None, r["c"], o["c"]).ratio() * o["conf"] for o in group), 9)
                    return (vote, r["conf"], -sum(len(t) <= 1 for t in r["c"].split()), len(r["c"].replace(" ", "")), -r["o"])
                winners.append(max(group, key=rank))
        if not winners:
            assert d not in got
            continue
        assert got[d]["address_lines"] == [w["c"] for w in winners]
        assert got[d]["raw_text"] == " ".join(w["raw"] for w in winners).strip()
        assert abs(got[d]["confidence"] - sum(w["conf"] for w in winners) / len(winners)) <= 0.00005001


def test_known_name_replaces_a_damaged_one(spark):
    rows = [("S/O GANGHPPA", "GANGAPPA", "RAVI"), ("S/O RAVJ", "GANGAPPA", "RAVI"), ("MAIN ROAD", "MAIN", "ROAD"), ("S/O XYZ", "GANGAPPA", "")]
    df = spark.createDataFrame(rows, "line string, father_name string, name string").select(
        "father_name", "name", F.struct(F.lit("?").alias("full_address"), F.col("line").alias("address_line_1"),
                                       F.array("line", F.lit("TOWN")).alias("line_items")).alias("address"))
    got = [r["address"]["full_address"] for r in address.repair_address(df).collect()]
    assert got == ["S/O GANGAPPA TOWN", "S/O RAVI TOWN", "MAIN ROAD TOWN", "S/O XYZ TOWN"]


def test_last_box_prefers_a_close_seven(spark):
    digits = "01011954"
    rows = [(1, 0, i, 0, "vote", c, 0.9) for i, c in enumerate(digits)]
    rows += [(1, 0, 7, 1, "vote", "7", 0.5), (2, 0, 7, 0, "hint", "Y", 0.9)]
    rows += [(3, 0, i, 0, "vote", c, 0.9) for i, c in enumerate(digits)] + [(3, 0, 7, 1, "hint", "Y1", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, box_set int, box_idx int, ordinal long, kind string, raw_text string, confidence double")
    got = {r["doc_id"]: r["clean_text"] for r in dob.boxed_dob(df).collect()}
    assert got == {1: "01/01/1957", 3: "01/01/1957"}  # document 2 has a hint but no vote
    winners = {r["doc_id"] for r in dob.box_winners(dob.digit_votes(df)).collect()}
    assert winners == {1, 3}


def test_segments_that_share_their_ordinal_do_not_depend_on_the_order_of_rows(spark):
    from scanweave.operators.dob import segment_winners

    rows = [(1, "day", 5, text, 0.5) for text in ("12", "I7", "31", "05")]
    schema = "doc_id long, segment string, ordinal long, raw_text string, confidence double"
    orders = [rows, rows[::-1], rows[2:] + rows[:2], rows[1:] + rows[:1]]
    got = {segment_winners(spark.createDataFrame(o, schema).coalesce(1)).first() for o in orders}
    assert [r["raw_text"] for r in got] == ["I7"]


def test_address_reads_are_cleaned_once(spark, tmp_path):
    rows = [(d, w, i, "base", f"MAIN {'X' * i} ROAD", 0.5) for d in range(20) for w in range(2) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, line_idx int, ordinal long, variant string, raw_text string, confidence double").write.parquet(f"{tmp_path}/reads")
    out = address.address_vote(spark.read.parquet(f"{tmp_path}/reads"))
    assert out.count() == 20
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
