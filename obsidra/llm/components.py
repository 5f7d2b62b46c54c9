"""Connected components by alternating large-star and small-star rounds, a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Edges up to which the least neighbours are broadcast instead of shuffled to a hub's edges.
BROADCAST_EDGES = 200_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star round over edges (u, v) with u > v; ``few``: at most BROADCAST_EDGES of them, as counted."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(F.broadcast(least) if few else least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has an edge (columns a, b); component is the smallest node reachable.

    Nodes of any orderable type; edges to itself and null ends are ignored. Every round writes its edges, so a lost
    executor costs one round at most. Ends when the edges are stars, which both rounds leave as they are.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", small=True)
    for _ in range(rounds):
        # stars: no node is both the top of one edge and the bottom of another, and every top has one bottom
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("top"), F.lit(0).alias("bottom")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("top"), F.lit(1).alias("bottom")))
        nodes = ends.groupBy("node").agg(F.sum("top").alias("tops"), F.max("bottom").alias("bottom"))
        known = nodes.agg(F.coalesce(F.bool_or(F.col("tops") + F.col("bottom") * F.signum("tops") > 1), F.lit(False)).alias("open"), F.coalesce(F.sum("tops"), F.lit(0)).alias("edges")).first()
        if not known["open"]:
            break
        few = known["edges"] <= BROADCAST_EDGES
        now = staged(_star(_star(now, True, few), False, few), "edges", small=True)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
