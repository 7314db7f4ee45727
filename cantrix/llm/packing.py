"""Best-fit decreasing packing of tokenised documents into windows.

Documents are cut into full windows and a tail. Only a tail's length matters to best fit, so the
driver packs the histogram of tail lengths (at most ``window`` numbers, whatever the input): a
segment tree over remaining capacities finds the tightest open windows, and all windows of one
capacity are filled together. The plan is a short list of runs, "tails of this length and these
ranks go to these sequences at this offset", that every piece looks up by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import TEXT, cut
from .bpe import shared
from .textbuf import chunks

#: Pieces ranked together by one sort: rank classes are split by a hash into groups of about so many.
GROUP = 2000


class Capacities:
    """Segment tree over remaining capacities: the smallest one of at least some length with open windows."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.open: dict[int, list[tuple[int, int]]] = {}  # capacity: (first sequence, how many)

    def _set(self, capacity: int, value: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity > 0 and count > 0:
            self.open.setdefault(capacity, []).append((first, count))
            self._set(capacity, True)

    def pop(self, least: int) -> tuple[int, int, int] | None:
        """Take the windows of the tightest fitting capacity: (capacity, first sequence, how many)."""
        at = least + self.leaves
        if not self.any[at]:
            while at > 1 and (at % 2 == 1 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        first, count = self.open[capacity].pop()
        if not self.open[capacity]:
            self._set(capacity, False)
        return capacity, first, count


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset) and the number of sequences."""
    tree, runs, sequences = Capacities(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            got = tree.pop(length)
            if got is None:
                each = window // length
                got = (window, sequences, -(-(end - rank) // each))
                sequences += got[2]
            capacity, first, count = got
            each, left = capacity // length, end - rank
            # the tightest window takes as many as it can before the next one is touched
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            for k in range(each if full else 0):
                runs.append((length, rank, rank + full, first, window - capacity + k * length))
                rank += full
            for k in range(rest):
                runs.append((length, rank, rank + 1, first + full, window - capacity + k * length))
                rank += 1
            tree.add(capacity - each * length, first, full)
            if full < count:
                tree.add(capacity - rest * length, first + full, 1)
                tree.add(capacity, first + full + 1, count - full - 1)
    return runs, sequences


def pieces(docs: DataFrame, window: int, text: str, key: str, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """Full windows and the tail of each document; ``ids`` only on request."""
    kind = docs.schema[key].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(vocabulary)
        for b in batches:
            keys = b.column(0)
            for t in chunks(b.column(1)):
                of, start, crc, size, parts = [], [], [], [], []
                for i, ids in enumerate(bpe.ids(t)):
                    raw = np.append(ids, np.uint32(0)).astype("<u4")
                    for at in range(0, len(raw), window):
                        part = raw[at : at + window]
                        of.append(t.first + i)
                        start.append(at)
                        crc.append(zlib.crc32(part.tobytes()))
                        size.append((len(part), len(raw)))
                        if with_ids:
                            parts.append(part)
                length, total = np.array(size, np.int64).T
                columns = [keys.take(pa.array(of)), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(total)]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()

    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(TEXT)).mapInArrow(run, schema)


def pack(docs: DataFrame, window: int = 1024, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and then id 0; a null or empty text is id 0 alone. Full windows are
    sequences of their own; tails share sequences by best fit decreasing, and their offsets run
    gapless from 0. Repeated rows are packed as often as they occur; rows with one key, or none, and
    different texts are dealt apart by the checksums of their pieces. A very long text is tokenised whole, as
    a chunk of its own. Other columns, whatever their names, are not read. An empty table gives no rows.
    Which of several tails of one length takes which place depends on hashes of key and ids alone.
    """
    rows = cut(pieces(docs, window, text, key, vocabulary, with_ids))
    groups = max(1, rows.count() // GROUP)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), "start", "ids_crc32", "doc_tokens"), F.lit(groups)).cast("int"))
    held = cut(rows.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_held")))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_held").alias("n")).collect()}
    runs, sequences = best_fit_decreasing({k: v for k, v in counts.items() if k < window}, window)
    if window in counts:
        runs.append((window, 0, counts[window], sequences, 0))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "_group", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_group").orderBy(F.col(f"`{key}`").cast("string"), "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(held, ["length", "_group"])
    # at most a few runs for each length and capacity: bounded by the window, not by the input
    plan = rows.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_length bigint, _first bigint, _end bigint, _sequence bigint, _offset bigint")
    at = F.col("_before") + F.col("_rank")
    out = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (at >= F.col("_first")) & (at < F.col("_end")))
    extra = ["ids"] if with_ids else []
    return out.select(f"`{key}`", "start", "length", "ids_crc32", "doc_tokens", (F.col("_sequence") + at - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"), *extra)
