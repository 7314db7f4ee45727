"""Runs of words that are frequent over all texts: longer runs are looked for only where the shorter ones in them are frequent.

Every run that is counted is counted whole and exactly; what a text does not hand on cannot be frequent, as each of its
parts occurs at least as often as it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..sources.tables import written

#: Words that are counted together before they leave Python.
CHUNK = 1_000_000
#: Lengths that one reading of the texts counts, and the length whose frequent runs decide where.
ROUNDS = (((1, 2), 0), ((3,), 2), ((4, 5), 3))
#: White space as the expression ``\s`` of the engine has it.
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Bits of the sieve for each frequent run, and the parts in which it is made.
BITS, PARTS = 16, 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at each place."""
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * STEP + words[j : len(words) - k + 1 + j]
    return (out ^ (out >> np.uint64(32))) * STEP


class Sieve:
    """A bit for each hash value: says no only where no frequent run has that hash."""

    def __init__(self, width: int, parts: dict[int, bytes]) -> None:
        self.width, self.bits = width, np.concatenate([np.frombuffer(parts.get(p, bytes(width // 8)), np.uint8) for p in range(PARTS)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(58)) * np.uint64(self.width) + hashes % np.uint64(self.width)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _sieve(grams: DataFrame, k: int) -> Sieve:
    """The sieve of the frequent runs of ``k`` words; its parts are made by tasks and put together on the driver."""
    n = grams.filter(F.col("k") == k).count()
    width = max(64, -(-n * BITS // PARTS) // 8 * 8 + 8)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [[_hash(w) for w in g.split(" ")] for g in batch.column("gram").to_pylist()]
            if some:
                h = np.array(some, np.uint64)
                got = _rolled(h.reshape(-1), k)[::k] if k > 1 else _rolled(h.reshape(-1), 1)
                yield pa.record_batch([pa.array((got >> np.uint64(58)).astype(np.int32)), pa.array((got % np.uint64(width)).astype(np.int64))], ["part", "at"])

    def parts(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(width // 8, np.uint8)
        at = table.column("at").to_numpy()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    at = grams.filter(F.col("k") == k).select("gram").mapInArrow(hashes, "part int, at bigint")
    made = at.groupBy("part").applyInArrow(parts, "part int, bits binary").collect()  # PARTS rows at most
    return Sieve(width, {r["part"]: bytes(r["bits"]) for r in made})


class _Words:
    """Words of some texts as numbers of their normalised forms."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        of, number, own = self.of, self.number, SPACE.split(text)
        if own and not own[0]:
            own = own[1:]
        if own and not own[-1]:
            own.pop()
        for w in own:
            if w not in of:
                of[w] = number.setdefault(normalized(w), len(number))
        self.held.append(np.array([of[w] for w in own], np.int64))
        self.size += len(own)

    def runs(self, lengths: tuple[int, ...], base: int, sieve: Sieve | None) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(k, runs, times) of these texts; where there is a sieve, only runs all of whose parts of ``base`` words pass it."""
        names, many = list(self.number), max(1, len(self.number))
        ids = np.concatenate(self.held)
        text = np.repeat(np.arange(len(self.held)), [len(x) for x in self.held])
        fine = None
        if sieve is not None and len(ids) >= base:
            fine = sieve.has(_rolled(np.array([_hash(w) for w in names], np.uint64)[ids], base))
        for k in lengths:
            if len(ids) < k:
                continue
            keep = text[: len(ids) - k + 1] == text[k - 1 :]
            if fine is not None:
                for j in range(k - base + 1):
                    keep &= fine[j : j + len(keep)]
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            run = pd.factorize(ids[at])[0]
            for j in range(1, k):
                run = pd.factorize(run * many + ids[at + j])[0]
            times = np.bincount(run)
            first = np.empty(len(times), np.int64)
            first[run[::-1]] = np.arange(len(run))[::-1]
            grid = ids[at[first][:, None] + np.arange(k)]
            yield k, [" ".join([names[i] for i in row]) for row in grid.tolist()], times


def frequent(texts: DataFrame, text: str, least: int) -> DataFrame:
    """``gram``, ``k`` and ``n`` of the runs of one to five normalised words that occur ``least`` times or more over all texts.

    Each of ``ROUNDS`` reads the texts once. A chunk of texts is counted before it leaves Python, and the counts of all chunks
    are added by Spark.
    """
    found: DataFrame | None = None
    for lengths, base in ROUNDS:
        sieve = texts.sparkSession.sparkContext.broadcast(_sieve(found, base)) if base else None

        def count(batches: Iterator[pa.RecordBatch], lengths=lengths, base=base, sieve=sieve) -> Iterator[pa.RecordBatch]:
            own = _Words()

            def made() -> Iterator[pa.RecordBatch]:
                for k, grams, times in own.runs(lengths, base, sieve.value if sieve else None):
                    for low in range(0, len(grams), 50_000):
                        some = grams[low : low + 50_000]
                        yield pa.record_batch([pa.array(some, pa.string()), pa.array(np.full(len(some), k, np.int32)), pa.array(times[low : low + 50_000].astype(np.int64))], ["gram", "k", "n"])

            for batch in batches:
                for one in batch.column(0):
                    held = one.as_py()
                    if held is None:
                        continue
                    own.add(held)
                    if own.size >= CHUNK:
                        yield from made()
                        own = _Words()
            if own.size:
                yield from made()

        counts = texts.select(text).mapInArrow(count, "gram string, k int, n bigint")
        new = written(counts.groupBy("gram", "k").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        if sieve:
            sieve.destroy()
        found = new if found is None else found.unionByName(new)
    return found
