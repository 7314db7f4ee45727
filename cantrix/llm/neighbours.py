"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is routed to one leaf of each tree. A query
walks all trees through one shared priority queue, nearest splitting planes first, until the
visited leaves hold enough vectors; those are reranked by their exact distances. A leaf is dealt
to blocks of about ``BLOCK`` vectors, so no task holds a leaf, however many vectors it has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import cut
from .textbuf import U64, splitmix

#: Vectors of a leaf that meet queries in one task, about; results that a task gathers before it keeps the best.
BLOCK, GATHER = 4096, 400_000


@dataclass(frozen=True)
class Setting:
    """fit_rows: bound of the sample; leaf: sample vectors of a leaf at most.

    A query stops once its leaves over all trees hold ``share`` of the sample, and ``visit`` vectors at least.
    """

    trees: int = 8
    fit_rows: int = 60_000
    leaf: int = 192
    visit: int = 4096
    share: float = 1.1
    seed: int = 11


class Tree:
    """Arrays of one tree: direction, threshold and children of each node; a leaf has children -1."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.normal: list[np.ndarray] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.held: list[int] = []
        self._grow(x, leaf, rng)
        self.normal, self.cut, self.child, self.held = np.array(self.normal, np.float64).reshape(len(self.cut), -1), np.array(self.cut), np.array(self.child), np.array(self.held)

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, above = todo.pop()
            me = len(self.cut)
            if above:
                parent, side = above
                both = list(self.child[parent])
                both[side] = me
                self.child[parent] = tuple(both)
            direction = rng.normal(size=x.shape[1])
            self.normal.append(direction / np.linalg.norm(direction))
            self.cut.append(0.0)
            self.child.append((-1, -1))
            self.held.append(len(rows))
            if len(rows) <= leaf:
                continue
            p = x[rows] @ self.normal[me]
            at = float(np.median(p))
            left = p < at
            if not left.any() or left.all():
                continue  # equal vectors
            self.cut[me] = at
            todo += [(rows[left], (me, 0)), (rows[~left], (me, 1))]

    def route(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            live = live[self.child[node[live], 0] >= 0]
            at = node[live]
            right = (np.einsum("ij,ij->i", x[live], self.normal[at]) >= self.cut[at]).astype(np.int64)
            node[live] = self.child[at, right]
        return node


def search(trees: list[Tree], q: np.ndarray, visit: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs by one queue over all trees, until their leaves hold ``visit`` sample vectors.

    A branch's priority is the sum of squared distances to the planes that lead away from the query.
    """
    queue = [(0.0, t, 0) for t in range(len(trees))]
    projected = [t.normal @ q - t.cut for t in trees]
    out, held = [], 0
    while queue and held < visit:
        path, t, node = heapq.heappop(queue)
        tree = trees[t]
        while tree.child[node, 0] >= 0:
            margin = projected[t][node]
            near = int(margin >= 0)
            heapq.heappush(queue, (path + margin * margin, t, int(tree.child[node, 1 - near])))
            node = int(tree.child[node, near])
        out.append((t, node))
        held += int(tree.held[node])
    return out


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def forest(x: np.ndarray, setting: Setting) -> list[Tree]:
    rng = np.random.default_rng(setting.seed)
    return [Tree(x, setting.leaf, rng) for _ in range(setting.trees)]


def _blob(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = m.shape[1] * m.itemsize
    ends = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _lists(x: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in x)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)))


class _Best:
    """Results of queries, cut down to the ``k`` nearest of each whenever many are held."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.n = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n > GATHER:
            self.trim()

    def trim(self) -> None:
        query, asked, found, mark, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((mark, found, score, asked, query))
        query, asked, found, mark, score = (x[order] for x in (query, asked, found, mark, score))
        new = np.ones(len(query), bool)  # several trees find the same row, with the same distance
        new[1:] = (query[1:] != query[:-1]) | (asked[1:] != asked[:-1]) | (found[1:] != found[:-1]) | (mark[1:] != mark[:-1])
        query, asked, found, mark, score = (x[new] for x in (query, asked, found, mark, score))
        start = np.ones(len(query), bool)
        start[1:] = (query[1:] != query[:-1]) | (asked[1:] != asked[:-1])
        first = np.flatnonzero(start)
        keep = np.arange(len(query)) - first[np.cumsum(start) - 1] < self.k
        self.held = [tuple(x[keep] for x in (query, asked, found, mark, score))]
        self.n = int(keep.sum())


def closest(m: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the rows of m that can be among its k nearest, with exact distances; ties are all kept."""
    rough = (m * m).sum(1) + (q * q).sum(1)[:, None] - 2 * (q @ m.T)
    out = []
    for i, d in enumerate(rough):
        at = np.arange(len(m))
        if len(m) > k:
            limit = np.partition(d, k - 1)[k - 1]
            at = np.flatnonzero(d <= limit + 1e-9 * (abs(limit) + (q[i] * q[i]).sum()))  # far above the rounding of the product
        out.append((at, np.sqrt(((m[at] - q[i]) ** 2).sum(1))))
    return out


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, setting: Setting | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision), nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.
    Rows with one id and different vectors are queries and candidates of their own, so an id can come up
    again; rows with one id and one vector count once. Vectors that are null, zero, of another length than
    most of the sample, or hold null or non-finite components, and rows without id, take no part. Equal
    vectors are one entry of the index with its k + 1 smallest ids, which is all that k results can show.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    setting = setting or Setting()
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    dtype = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    rows = rows.withColumn("mark", F.xxhash64("x"))
    order = Window.partitionBy("mark", "x").orderBy("id")
    kept = rows.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    entries = cut(kept.groupBy("mark", "x").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    queries = rows.filter(F.col("id") % every == 0).distinct()

    sample = entries.orderBy("mark").limit(setting.fit_rows).select("x").toArrow()
    flat = [np.array(v, np.float64) for v in sample["x"].to_pylist()]
    if not flat:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    length = np.bincount([len(v) for v in flat]).argmax()
    fitted = np.stack([v for v in flat if len(v) == length])
    grown = entries.count() / len(flat)
    size, visit = int(length), max(setting.visit, int(setting.share * len(fitted)))
    trees = forest(fitted, setting)
    # slots: the blocks of each leaf, numbered through all trees
    blocks = [np.maximum(1, np.ceil(t.held * grown / BLOCK)).astype(np.int64) * (t.child[:, 0] < 0) for t in trees]
    slots = np.split(np.cumsum(np.concatenate(blocks)) - np.concatenate(blocks), np.cumsum([len(x) for x in blocks])[:-1])
    shared = spark.sparkContext.broadcast((trees, blocks, slots))
    names = ["slot", "asks", "x", "mark", "ids"]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, blocks, slots = shared.value
        for b in batches:
            if len(b):
                m = matrix(b.column(0))
                blob, chance = _blob(m), splitmix(b.column(1).to_numpy().view(U64)) >> U64(1)
                for t, tree in enumerate(trees):
                    leaf = tree.route(m.astype(np.float64))
                    slot = slots[t][leaf] + chance.astype(np.int64) % blocks[t][leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.zeros(len(b), bool)), blob, b.column(1), b.column(2)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, blocks, slots = shared.value
        for b in batches:
            if len(b):
                m = matrix(b.column(0))
                for low in range(0, len(b), 64):
                    found = [np.concatenate([np.arange(slots[t][leaf], slots[t][leaf] + blocks[t][leaf]) for t, leaf in search(trees, q, visit)]) for q in m[low : low + 64].astype(np.float64)]
                    at = low + np.repeat(np.arange(len(found)), [len(x) for x in found])
                    ids = b.column(2).to_numpy()[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.ones(len(at), bool)), _blob(m[at]), b.column(1).take(pa.array(at)), _lists(list(ids[:, None]))], names)

    same = F.size("x") == size
    schema = "slot bigint, asks boolean, x binary, mark bigint, ids array<bigint>"
    placed = entries.filter(same).select("x", "mark", "ids").mapInArrow(route, schema)
    asked = queries.filter(same).select("x", "mark", "id").mapInArrow(walk, schema)
    dealt = placed.unionByName(asked).repartition("slot").sortWithinPartitions("slot", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, held = _Best(k), None, []
        entry = None
        for b in batches:
            slot, asks, mark = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            m = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype).reshape(len(b), size).astype(np.float64)
            ids = b.column(4)
            ends, flat_ids = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy()
            first = np.cumsum(ends) - ends
            step = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (asks[1:] != asks[:-1])]))
            for low, high in zip(step.tolist(), [*step[1:].tolist(), len(b)], strict=True):
                if slot[low] != now:
                    now, held, entry = slot[low], [], None
                if not asks[low]:
                    held.append((m[low:high], mark[low:high], ends[low:high], flat_ids[first[low] : first[high - 1] + ends[high - 1]]))
                    continue
                if not held:
                    continue
                if entry is None:
                    entry = [np.concatenate(x) for x in zip(*held, strict=True)]
                    entry.append(np.cumsum(entry[2]) - entry[2])
                x, marks, n, every_id, start = entry
                for some in range(low, high, 256):
                    for i, (at, d) in enumerate(closest(x, m[some : min(some + 256, high)], k + 1), some):
                        count = n[at]
                        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                        found, of, score = every_id[np.repeat(start[at], count) + inner], np.repeat(marks[at], count), np.repeat(d, count)
                        own = flat_ids[first[i]]
                        other = (found != own) | (of != mark[i])
                        best.add(np.full(int(other.sum()), own), np.full(int(other.sum()), mark[i]), found[other], of[other], score[other])
        if best.held:
            best.trim()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held[0]], ["query_id", "asked", "vec_id", "mark", "score"])

    found = dealt.mapInArrow(rank, "query_id bigint, asked bigint, vec_id bigint, mark bigint, score double")
    single = found.groupBy("query_id", "asked", "vec_id", "mark").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id", "asked").orderBy("score", "vec_id", "mark")
    return single.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
