"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours of each node to the smallest of node and neighbours.

    Large star moves the neighbours above the node, small star those below it
    and the node itself. The minimum is combined before the shuffle and joined
    back, so no node's neighbours meet in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            down.join(least, "a")
            .select(F.col("b").alias("x"), "m")
            .unionByName(least.select(F.col("a").alias("x"), "m"))
        )
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of all nodes with an edge.

    ``edges`` has columns a and b (long). Each round is a table in the shared
    folder; the rounds end when one changes nothing.
    """
    current = scratch.table(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        count = current.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum("b")
        ).collect()[0]
        if count[0] == 0 or count == seen:
            break
        seen = count
        after = scratch.table(_star(_star(current, True), False), "edges")
        scratch.drop(current)
        current = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
