"""Connected components over tables of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones only, or the others) linked to the least id among node and neighbours.
    Links are (a, b) with a > b. The minimum of a node is a combinable aggregate, so a node with very many links isn't
    gathered in one place; it is joined back by node, where adaptive execution splits a hot key."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """node and component (the least node id of its component) for every node of a table of undirected links.

    Self links only name their node; links with a null end are left out, repeated links count once. An empty table
    gives an empty one. Large-star and small-star steps alternate until nothing changes, O(log n) rounds in practice;
    each round's links, at most as many as there were, are cut by a checkpoint, so an executor's loss costs one round.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = cut(_star(_star(state, True), False))
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(state.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
