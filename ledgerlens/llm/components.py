"""Connected components of a link table by alternating star contraction.

Every round links all larger neighbours of a node to its smallest neighbour
(large star), then all smaller ones (small star); links never lose
connectivity, and in the end they are stars around the smallest node of each
component.  Each round is written to a shared table; the driver sees one number
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b).  Each node sends its neighbours to the smallest one of
    them and itself."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    moved = both.join(low, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links (a > b) are stars: every node has one link upwards, or
    links downwards only."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"),
                                  F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("u"), F.max("down").alias("d")) \
        .where("u > 1 or (u = 1 and d = 1)")
    return odd.limit(1).count() == 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node) of all nodes in ``links`` (a, b)."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .where("a <> b").distinct()
    links = shared_table(links, "star")
    for _ in range(max_rounds):
        if _settled(links):
            break
        links = shared_table(_star(_star(links, True), False), "star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
