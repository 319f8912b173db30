"""Birth date from digit boxes, else from day/month/year segments, else from the crop."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions.dates import (
    DEFAULT_CURRENT_YEAR, clean_dob, dob_from_digits, dob_from_parts, repair_year_tail,
)
from scanweave.functions.geometry import dedupe_boxes, is_dob_box
from scanweave.functions.text import alnum_only, letters_to_digits, round4, vote_sum
from scanweave.operators.consensus import consensus

LAST_BOX = 7
HINT_WEIGHT = 4.0
TIE_WINDOW = 0.55


def _weights():
    table = {d: {d: 1.0} for d in "0123456789"} | K.BOX_DIGIT_WEIGHTS
    return F.create_map(*[
        v for ch, ws in table.items()
        for v in (F.lit(ch), F.array(*[
            F.struct(F.lit(d).alias("digit"), F.lit(w).alias("weight")) for d, w in ws.items()]))
    ])


def digit_votes(box_reads: DataFrame, group=("doc_id", "box_set", "box_idx")) -> DataFrame:
    """Score per box and digit.  The first telling character of a vote read counts; in the
    last box a leading Y, V or X of a hint read weighs in as well."""
    first = F.regexp_extract(F.upper("raw_text"), r"[0-9OQDILTJ|!:;ZSBGYVX]", 0)
    lead = F.left(alnum_only(F.col("raw_text")), F.lit(1))
    hint = F.when(lead.isin("Y", "V"), "7").when(lead == "X", "4")
    hinted = F.array(F.struct(hint.alias("digit"), F.lit(HINT_WEIGHT).alias("weight")))
    is_vote = F.col("kind") == "vote"
    votes = F.when(is_vote, F.try_element_at(_weights(), first)).when(
        (F.col("kind") == "hint") & (F.col("box_idx") == LAST_BOX) & hint.isNotNull(), hinted)
    return (
        box_reads.select(*group, "kind", "ordinal", "confidence", F.posexplode(votes).alias("pos", "v"))
        .groupBy(*group, F.col("v.digit").alias("digit"))
        .agg(
            vote_sum(F.col("confidence") * F.col("v.weight")).alias("score"),
            F.min(F.struct((F.col("kind") != "vote").alias("late"), "ordinal", "pos")).alias("seen"),
            F.count_if(F.col("kind") == "vote").alias("votes"),
        )
    )


def box_winners(votes: DataFrame, group=("doc_id", "box_set", "box_idx")) -> DataFrame:
    """Winning digit per box; in the last box a close 7 beats a 4."""
    late, ordinal, pos = F.col("seen.late"), F.col("seen.ordinal"), F.col("seen.pos")
    rank = F.struct("score", (~late).alias("early"), (-ordinal).alias("o"), (-pos).alias("p"))
    seven = F.max(F.when(F.col("digit") == "7", F.col("score")))
    best = votes.groupBy(*group).agg(
        F.max_by("digit", rank).alias("digit"), F.max("score").alias("score"),
        seven.alias("seven"), F.sum("votes").alias("votes"),
    )
    override = (
        (F.col("box_idx") == LAST_BOX) & (F.col("digit") == "4") & (F.col("seven") > 0)
        & (F.col("seven") >= F.col("score") * TIE_WINDOW)
    )
    return best.where("votes > 0").select(
        *group,
        F.when(override, F.lit("7")).otherwise(F.col("digit")).alias("digit"),
        F.when(override, F.col("seven")).otherwise(F.col("score")).alias("score"),
    )


def boxed_dob(box_reads: DataFrame, current_year=DEFAULT_CURRENT_YEAR, key="doc_id") -> DataFrame:
    """One row per document and box set whose eight digits make a date."""
    winners = box_winners(digit_votes(box_reads, (key, "box_set", "box_idx")), (key, "box_set", "box_idx"))
    digits = [F.max(F.when(F.col("box_idx") == i, F.col("digit"))).alias(f"d{i}") for i in range(8)]
    wide = winners.groupBy(key, "box_set").agg(
        *digits, F.count(F.lit(1)).alias("boxes"), F.avg("score").alias("mean_score")
    ).where((F.col("boxes") == 8) & F.concat(*[F.col(f"d{i}") for i in range(8)]).isNotNull())
    day, month = F.concat("d0", "d1"), F.concat("d2", "d3")
    year = F.concat("d4", "d5", "d6", "d7")
    return wide.select(
        key, "box_set",
        F.concat_ws(" ", day, month, year).alias("raw_text"),
        dob_from_digits(day, month, year, current_year).alias("clean_text"),
        round4(F.least(F.lit(0.99), F.col("mean_score") / 6)).alias("confidence"),
    ).where("clean_text <> ''")


def tail_hint(tail_reads: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Does the last character of the year reads speak for a misread 7?  hint_digit is 7 or
    empty, hint_letter the last Y or V seen."""
    text = alnum_only(F.col("raw_text"))
    tail, conf = F.right(text, F.lit(1)), F.col("confidence")
    letter = tail.isin("Y", "V")
    seven = F.when(letter, conf * 1.8).when(tail == "7", conf).otherwise(0.0)
    four = F.when(tail == "X", conf * 1.5).when(tail == "4", conf).otherwise(0.0)
    scored = tail_reads.groupBy(*keys).agg(
        vote_sum(seven).alias("score_7"), vote_sum(four).alias("score_4"),
        F.max_by(tail, F.when(letter, F.col("ordinal"))).alias("letter"),
    )
    speaks = (F.col("score_7") > F.col("score_4")) & F.col("letter").isNotNull()
    return scored.select(
        *keys, "score_7", "score_4",
        F.when(speaks, F.lit("7")).otherwise(F.lit("")).alias("hint_digit"),
        F.when(speaks, F.col("letter")).otherwise(F.lit("")).alias("hint_letter"),
    )


def segment_winners(segment_reads: DataFrame, key="doc_id") -> DataFrame:
    """Best read per day, month and year segment: enough digits, confidence, digits, first
    ordinal; reads that share even that go by their text, so that no order of rows decides."""
    digits = letters_to_digits(F.col("raw_text"))
    expected = F.when(F.col("segment") == "year", 4).otherwise(2)
    n = F.length("digits")
    return segment_reads.withColumn("digits", digits).groupBy(key, "segment").agg(
        F.max_by(
            F.struct(F.trim("raw_text").alias("raw_text"), "digits", "confidence"),
            F.struct(F.least(n, expected).alias("fit"), "confidence", n.alias("n"), (-F.col("ordinal")).alias("neg"), F.col("raw_text").alias("text")),
        ).alias("w")
    ).select(key, "segment", "w.*")


def segment_dob(segment_reads: DataFrame, current_year=DEFAULT_CURRENT_YEAR, key="doc_id") -> DataFrame:
    def of(name):
        return F.max(F.when(F.col("segment") == name, F.struct("raw_text", "digits", "confidence"))).alias(name)

    wide = segment_winners(segment_reads, key).groupBy(key).agg(of("day"), of("month"), of("year"))
    return wide.select(
        key,
        F.trim(F.concat_ws(" ", "day.raw_text", "month.raw_text", "year.raw_text")).alias("raw_text"),
        dob_from_parts(F.col("day.digits"), F.col("month.digits"), F.col("year.digits"), current_year).alias("clean_text"),
        round4((F.col("day.confidence") + F.col("month.confidence") + F.col("year.confidence")) / 3).alias("confidence"),
    ).where("clean_text <> ''")


def _boxed_offers(box_reads, tail_reads, current_year, key) -> DataFrame:
    boxed = boxed_dob(box_reads, current_year, key).withColumn("crop", F.floor(F.col("box_set") / 2).cast("int"))
    if tail_reads is not None:
        hints = tail_hint(tail_reads, (key, "crop")).select(key, "crop", "hint_digit", "hint_letter")
        boxed = boxed.join(hints, [key, "crop"], "left")
    else:
        boxed = boxed.withColumns({"hint_digit": F.lit(""), "hint_letter": F.lit(None).cast("string")})
    repaired = boxed.withColumn("r", repair_year_tail(
        F.col("clean_text"), F.col("raw_text"), F.coalesce("hint_digit", F.lit("")), F.col("hint_letter")))
    return repaired.select(key, F.col("box_set").cast("int").alias("rank"), "r.raw_text", "r.clean_text", "confidence")


def resolve_dob(box_reads: DataFrame = None, tail_reads: DataFrame = None, segment_reads: DataFrame = None,
                crop_reads: DataFrame = None, current_year=DEFAULT_CURRENT_YEAR, key="doc_id") -> DataFrame:
    """The cascade as one vote: every stage offers its dates with a rank and the lowest rank
    of a document wins.  Box sets 0 and 1 belong to the base crop, 2 and 3 to the clean one;
    ``tail_reads`` carry the crop (0 or 1) they were taken from.  A stage without reads offers
    nothing; one of boxes, segments and whole crops must be given."""
    offers = []
    if box_reads is not None:
        offers.append(_boxed_offers(box_reads, tail_reads, current_year, key))
    if segment_reads is not None:
        offers.append(segment_dob(segment_reads, current_year, key).select(
            key, F.lit(10).alias("rank"), "raw_text", "clean_text", "confidence"))
    if crop_reads is not None:
        whole = crop_reads.withColumn("clean_text", clean_dob(F.col("raw_text"), current_year)).withColumn(
            "raw_text", F.trim("raw_text")).withColumn("field", F.lit("dob"))
        offers.append(consensus(whole, (key,)).select(key, F.lit(20).alias("rank"), "raw_text", "clean_text", "confidence"))
    return functools.reduce(DataFrame.unionByName, offers).groupBy(key).agg(
        F.min_by(F.struct("raw_text", "clean_text", "confidence"), "rank").alias("w")
    ).select(key, "w.*")


def found_boxes(candidates: DataFrame, tolerance=4, key="doc_id") -> DataFrame:
    """Digit boxes among contour rectangles: by size, near-duplicates merged, first eight or
    none.  Of the rectangles at one x only the largest can stay, so a crop keeps at most one
    per pixel column before its boxes are brought together."""
    fits = is_dob_box(F.col("w"), F.col("h"), F.col("crop_w"), F.col("crop_h"))
    columns = candidates.where(fits).groupBy(key, "x").agg(
        F.max_by(F.struct("x", "y", "w", "h"),
                 F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("y")).alias("y"))).alias("box")
    )
    kept = columns.groupBy(key).agg(dedupe_boxes(F.collect_list("box"), tolerance).alias("boxes"))
    return kept.select(
        key, F.when(F.size("boxes") >= 8, F.slice("boxes", 1, 8)).otherwise(F.slice("boxes", 1, 0)).alias("boxes")
    )
