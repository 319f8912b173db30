"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is tied to the least of its neighbourhood;
    small: every smaller neighbour and the node itself."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.unionByName(back) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = seen.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node it reaches.
    Minima are combined before the shuffle and joins are plain equi joins, so a node with
    very many edges is split like any skewed key.  The state of each round is settled in the
    shared folder; only its row count and checksum reach the driver.  NULL ends and loops are
    left out; an empty table gives an empty result."""
    now = settle(edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        after = settle(_stars(_stars(now, True), False))
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if mark == new or new[0] == 0:
            break
        now, mark = after, new
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
