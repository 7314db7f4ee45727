"""Closures and components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def closure(edges: DataFrame, roots: DataFrame, limit: int = 100) -> DataFrame:
    """Every ``node`` that can be reached from the roots, which are part of it. ``edges`` has ``parent`` and ``child``.

    Only the newest level is joined in each step, against a written table; a step ends the loop when it finds nothing new.
    """
    edges = written(edges.select("parent", "child"))
    seen = front = written(roots.select("node").distinct())
    for _ in range(limit):
        reached = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = written(seen.unionByName(front))
    raise RuntimeError(f"more than {limit} levels")


def components(pairs: DataFrame, limit: int = 50) -> DataFrame:
    """``node`` and the smallest node it is connected with, by label propagation with path halving.

    Each round reads the labels that the round before has written, so neither plan nor lineage grows.
    """
    both = written(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = written(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(limit):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("low"))
        moved = written(labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")))
        jump = moved.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = written(moved.join(jump, moved["label"] == jump["_n"], "left").select("node", F.least("label", "_l").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def invalidation(edges: DataFrame, changed: DataFrame, kept: DataFrame) -> DataFrame:
    """What depends on the changed nodes, without what the kept nodes and their dependents cover."""
    return closure(edges, changed).join(closure(edges, kept), "node", "left_anti")
