"""Connected components: blocks of edges are contracted in one task each, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import cut, drop

#: Edges that one task contracts at once; the number of tasks grows with the edges.
BLOCK = 250_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) of the components of some edges, without the smallest nodes themselves."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    far = root != np.arange(len(node))
    return node[far], node[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= BLOCK:
            yield flush()
    if held:
        yield flush()


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of the edges (u, v) of bigints.

    Blocks of edges are contracted to stars first. Every round then replaces a node's edges by edges to
    its smallest neighbour, so the number of edges never grows and rounds are logarithmic in a component's length. The neighbours of one hub are
    aggregated before the shuffle and joined by a join that Spark can split.
    """
    whole = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"))
    blocks = -(-whole.count() // BLOCK)
    now = cut(whole.coalesce(max(1, blocks)).mapInArrow(_contract, "u bigint, v bigint"))
    drop(whole)
    if blocks <= 1:  # one task has seen every edge
        return _labelled(now)
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), "m").filter("a != m")
        after = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(after)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _labelled(now)


def _labelled(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
