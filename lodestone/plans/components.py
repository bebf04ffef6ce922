"""Connected components of a graph by alternating stars.

Every round points each vertex's larger neighbours (then its smaller ones) at the
smallest vertex of its neighbourhood. The number of rounds grows with the logarithm of
the longest path, and no vertex's neighbourhood is ever collected: minima are partial
aggregates, and the joins on a hot vertex are ones that Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """``id, component`` (its smallest id) of every vertex that has an edge.

    ``edges`` has the two columns ``u`` and ``v``; loops and repeated edges are ignored.
    ``keep`` writes a table where all executors reach it and reads it back, so that an
    executor lost in one round does not undo the rounds before it.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = keep(_star(_star(now, large=True), large=False))
        # the same edges again: every vertex points at its component's smallest
        seen = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
