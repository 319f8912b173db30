"""Votes across redundant reads of one field.

Reads are first reduced to one row per distinct cleaned text.  That step spreads a hot
(doc, field) group over its texts and combines on the map side; the winner is a second,
small aggregation.  No step collects the reads of a group.

Similarity votes compare every text of a group with every other.  The texts of a group are
dealt into tiles; the task of a tile holds its texts and streams all texts of the group past
them, so it ends with whole votes, and a group of any size is spread over its tiles.
"""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave import constants as K
from scanweave.functions.fuzzy import gestalt_ratio
from scanweave.functions.text import round4, vote_sum

#: texts of a tile, about
CHUNK = 2048
#: reads of a group whose texts may meet in one row
FEW = 256
#: binary places of a vote; sums of whole numbers do not depend on their order
PLACES = 80


def text_buckets(reads: DataFrame, keys, *more) -> DataFrame:
    """Per distinct clean text: support, confidence sum, first ordinal, the raw text of the
    best read (last of equals) and the single best read (first of equals)."""
    conf, ordinal = F.col("confidence"), F.col("ordinal")
    return reads.groupBy(*keys, "clean_text").agg(
        F.count(F.lit(1)).alias("support"),
        vote_sum(conf).alias("conf_sum"),
        F.min(ordinal).alias("first_ordinal"),
        F.max_by("raw_text", F.struct(conf, ordinal)).alias("last_raw"),
        F.max(F.struct(conf.alias("conf"), (-ordinal).alias("neg"), F.col("raw_text").alias("raw"))).alias("best"),
        *more,
    )


def consensus(reads: DataFrame, keys=("doc_id",), field="field") -> DataFrame:
    """Winner per document and field: raw_text, clean_text, confidence.

    Most support wins, then confidence sum, length and first appearance.  Name fields
    whose texts are all different are decided by similarity votes instead.  If no read
    cleans to anything, the most confident raw read stands, with no clean text.
    """
    group = [*keys, field]
    stated = F.col("clean_text") != ""
    # A blank text wins only where there is no other; its best read is the one that stands then.
    winner = F.struct(
        stated.alias("stated"), F.col("support"), F.col("conf_sum"), F.length("clean_text").alias("n"),
        (-F.col("first_ordinal")).alias("neg"), F.col("clean_text").alias("clean"), F.col("last_raw").alias("raw"), "best",
    )
    # Whether a field is a name is a sum of its buckets, which is not asked before them; and both
    # branches below use the same columns: so they share a shuffle, and the reads are scanned once.
    buckets = text_buckets(reads, group, F.max(F.coalesce(F.col(field).isin(K.NAME_FIELDS), F.lit(False))).alias("is_name"))
    whole = buckets.groupBy(*group).agg(F.max(winner).alias("w"), F.count_if(stated).alias("n_texts"), F.max("is_name").alias("is_name"))
    differ = F.col("is_name") & F.col("w.stated") & (F.col("w.support") == 1)
    settled = F.struct(
        F.when(~F.col("w.stated"), F.col("w.best.raw")).when(F.col("w.raw") != "", F.col("w.raw")).otherwise(F.col("w.clean")).alias("raw_text"),
        F.col("w.clean").alias("clean_text"),
        F.when(F.col("w.stated"), round4(F.col("w.conf_sum") / F.col("w.support"))).otherwise(F.col("w.best.conf")).alias("confidence"),
    )
    alone = F.struct(F.col("w.best.raw").alias("raw_text"), F.col("w.clean").alias("clean_text"), F.col("w.best.conf").alias("confidence"))
    decided = whole.where(~(differ & (F.col("n_texts") > 1))).select(*group, F.when(differ, alone).otherwise(settled).alias("r"))
    texts = Window.partitionBy(*group)
    names = buckets.where("is_name").withColumns({
        "n_texts": F.count_if(stated).over(texts), "most": F.max(F.when(stated, F.col("support"))).over(texts)})

    def rank(vote):
        return F.struct(vote.alias("vote"), F.col("best.conf").alias("conf"), (-F.length("clean_text")).alias("n"), (-F.col("first_ordinal")).alias("neg"))

    voted = similarity_winners(names.where(stated & (F.col("n_texts") > 1) & (F.col("most") == 1)).drop("most"), group, rank)
    return decided.unionByName(voted).select(*group, "r.*")


def similarity_winners(buckets: DataFrame, group, rank) -> DataFrame:
    """Winner ``r`` (raw_text, clean_text, confidence) of every group.  ``buckets`` hold no blank
    texts and, from a window over the group, ``n_texts``.  The vote of a text is the sum over
    all texts of the group of their ratio times the other's confidence sum; ``rank`` makes the
    order from it."""
    tiles = F.ceil(F.col("n_texts") / CHUNK).cast("int")
    dealt = buckets.withColumn("home", F.explode(F.sequence(F.lit(0), tiles - 1)))
    at_home = F.pmod(F.xxhash64("clean_text"), tiles) == F.col("home")
    placed = dealt.withColumn("resident", at_home).repartition(*group, "home").sortWithinPartitions(
        *group, "home", F.desc("resident"), "clean_text")
    columns = [c for c in buckets.columns if c not in (*group, "n_texts")]
    ordered = placed.select(*group, "home", "resident", *columns)
    schema = ordered.drop("home", "resident").withColumn("vote", F.lit(0.0)).schema
    voted = ordered.mapInArrow(_whole_votes(len(group)), schema)
    read = F.struct(F.col("best.raw").alias("raw_text"), "clean_text", F.col("best.conf").alias("confidence"))
    return voted.groupBy(*group).agg(F.max_by(read, rank(F.round("vote", 9))).alias("r"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _few_votes(texts: pa.Array, weights: pa.Array) -> pa.Array:
    """The votes for every text of each group."""

    def votes(some, weigh):
        if len(some) == 1:
            return [_scaled(weigh[0]) / (1 << PLACES)]
        return [sum(_scaled(gestalt_ratio(a, b) * w) for b, w in zip(some, weigh)) / (1 << PLACES) for a in some]

    return pa.array([votes(*group) for group in zip(texts.to_pylist(), weights.to_pylist())], pa.list_(pa.float64()))


def winners_of_few(buckets: DataFrame, group, order) -> DataFrame:
    """Winner ``r`` as of ``similarity_winners``, for groups of at most ``FEW`` reads: the texts of a
    group meet in one row, so nothing is shuffled where the reads of a group are together.
    ``order`` makes the order from a vote, a text and its best read."""
    held = buckets.groupBy(*group).agg(F.collect_list(F.struct("clean_text", "conf_sum", "best")).alias("texts"))
    voted = held.withColumn("votes", _few_votes(F.col("texts.clean_text"), F.col("texts.conf_sum")))

    def ranked(t, vote):
        read = F.struct(t["best"]["raw"].alias("raw_text"), t["clean_text"].alias("clean_text"), t["best"]["conf"].alias("confidence"))
        return F.struct(order(F.round(vote, 9), t["clean_text"], t["best"]).alias("order"), read.alias("read"))

    return voted.select(*group, F.array_max(F.zip_with("texts", "votes", ranked))["read"].alias("r"))


def _scaled(x: float) -> int:
    return int(math.ldexp(x, PLACES))


def _whole_votes(n_keys):
    """Texts of a task come by group and tile, those of the tile first.  Holds these and adds
    what every text that passes by votes for them."""

    def run(batches):
        place, held, votes = None, [], []  # held: (batch, row, text, weight) of the tile's own texts

        def batches_of(done):
            """Rows with their votes, taken from each batch at once."""
            for source in {id(b): b for b, _, _ in done}.values():
                mine = [(i, v) for b, i, v in done if b is source]
                taken = source.take(pa.array([i for i, _ in mine], pa.int64()))
                yield taken.append_column(pa.field("vote", pa.float64()), pa.array([v / (1 << PLACES) for _, v in mine], pa.float64()))

        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(n_keys + 1)]
            resident = batch.column("resident").to_pylist()
            texts, weights = batch.column("clean_text").to_pylist(), batch.column("conf_sum").to_pylist()
            kept = batch.select([c for c in batch.schema.names if c not in ("home", "resident")])
            done = []
            for i, here in enumerate(zip(*keys)):
                if here != place:
                    done += [(b, r, v) for (b, r, _, _), v in zip(held, votes)]
                    place, held, votes = here, [], []
                text, weight = texts[i], weights[i]
                if not resident[i]:
                    for j, (_, _, t, _) in enumerate(held):
                        votes[j] += _scaled(gestalt_ratio(t, text) * weight)
                    continue
                own = _scaled(weight)  # its ratio with itself is 1
                for j, (_, _, t, w) in enumerate(held):
                    own += _scaled(gestalt_ratio(text, t) * w)
                    votes[j] += _scaled(gestalt_ratio(t, text) * weight)
                held.append((kept, i, text, weight))
                votes.append(own)
            yield from batches_of(done)
        yield from batches_of([(b, r, v) for (b, r, _, _), v in zip(held, votes)])

    return run
