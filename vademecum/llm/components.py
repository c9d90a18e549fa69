"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; edges shrink to stars around the smallest id of each component within a
number of rounds that grows with the logarithm of the longest path. Every round is written to the shared folder, so a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.llm.shared import written

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to its smallest neighbour. Edges have a < b."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    linked = edges.join(least, F.col("b") == F.col("u")).select(F.col("m"), F.col("a"))
    stars = linked.where("m <> a").toDF("a", "b").union(least.select("m", "u").toDF("a", "b"))
    return stars.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b); component is the smallest id reachable.

    Edges with a null end and loops are left out. No edges give no rows.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
