"""Connected components of an undirected graph whose node ids are random 64-bit numbers (hashes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpoint

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, one row per node with an edge; nodes of one component share the root.

    Each round every node takes the smallest id among itself and its neighbours as parent and the edges move to
    the parents, so that the graph shrinks. Ids must be hashes: then no path of rising ids is long. A round
    reads and writes tables that follow the edges left; nothing is collected but the number of edges.
    """
    both = (edges.where("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct())
    left, found = checkpoint(both), None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        parent = checkpoint(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        at_a = parent.select("a", F.col("p").alias("pa"))
        at_b = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = (left.join(at_a, "a").join(at_b, "b").where("pa <> pb")
                 .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        moved = checkpoint(moved)
        if found is None:
            found = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = checkpoint(
                found.join(parent.select(F.col("a").alias("root"), "p"), "root", "left")
                .select("node", F.coalesce("p", "root").alias("root")))
        left = moved
    else:
        raise RuntimeError("components did not settle; are the node ids hashes?")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
