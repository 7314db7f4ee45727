"""Arrow string columns as flat numpy buffers, and vectorised word tables over them.

Every text operator of this subpackage reads whole texts through here. A column is cut into
chunks of a megabyte or so (always whole texts), so peak memory is a fixed multiple of
``CHUNK_BYTES`` or of the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES, ROWS = 1 << 20, 1024
U64 = np.uint64

#: The separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
#: A-Z to a-z, byte by byte; UTF-8 continuation bytes stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each value; the same on every worker and in every run."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BASE = U64(0xD6E8FEB86659FD93)


@dataclass
class Texts:
    """Whole texts of some rows: ``data[offsets[i]:offsets[i + 1]]`` is the UTF-8 of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts in row order, null as empty with valid False; each chunk has whole texts.

    Rows are taken ``ROWS`` at a time, so no copy of a whole batch is made.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for base in range(0, len(column), ROWS):
        some = column.slice(base, ROWS)
        valid = ~np.asarray(some.is_null())
        some = some.cast(pa.large_string()).fill_null("")
        _, off, data = some.buffers()
        offsets = np.frombuffer(off, np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(some):
            stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), len(some))
            low, high = offsets[start], offsets[stop]
            yield Texts(base + start, data[low:high], offsets[start : stop + 1] - low, valid[start:stop])
            start = stop


@dataclass
class Words:
    """Words of a chunk: byte spans, the row of each, first word of each row, and 64-bit fingerprints."""

    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def words(t: Texts, separators: np.ndarray = SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Maximal runs of bytes that are no separators, never across texts."""
    data = LOWER[t.data] if lower else t.data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separators[data]
    opens = inside[:n].copy()
    if n:
        opens[1:] &= ~inside[: n - 1]
    # a text that starts inside a run of bytes starts a word of its own
    begins = t.offsets[:-1][t.offsets[:-1] < n]
    opens[begins] |= inside[begins]
    start = np.flatnonzero(opens)
    shut = inside[:n] & ~inside[1:]
    ends = t.offsets[1:]
    ends = ends[ends > 0] - 1
    shut[ends] |= inside[ends]
    stop = np.flatnonzero(shut) + 1
    row = np.searchsorted(t.offsets, start, "right") - 1
    first = np.searchsorted(start, t.offsets, "left")
    fingerprint = np.zeros(0, U64)
    if hashed:
        fingerprint = span_hash(data, start, stop)
    return Words(start, stop, row, first, fingerprint)


def lanes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each span as 8-byte lanes, the last one filled up with zeros: values, first lane and number of lanes of each."""
    length = stop - start
    count = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(count) - count
    inner = np.arange(int(count.sum())) - np.repeat(first, count)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    every = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    value = every[np.repeat(start, count) + 8 * inner]
    last = first + count - 1
    left = length - 8 * (count - 1)
    value[last] &= np.where(left >= 8, ~U64(0), (U64(1) << (8 * np.minimum(left, 7)).astype(U64)) - U64(1))
    return value, first, count


def _spans_hash(value: np.ndarray, first: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    inner = np.arange(len(value)) - np.repeat(first, count)
    with np.errstate(over="ignore"):
        place = splitmix(np.arange(int(count.max())))[inner]
        mixed = splitmix(value ^ place) * (place | U64(1))
        return splitmix(np.add.reduceat(mixed, first) + splitmix(length))


def span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span of bytes.

    Every lane is mixed with its place by a function that is not linear, so repetitive spans do not
    cancel out as they do in a polynomial modulo 2**64.
    """
    if not len(start):
        return np.zeros(0, U64)
    value, first, count = lanes(data, start, stop)
    return _spans_hash(value, first, count, stop - start)


def distinct(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal where the bytes are equal, and the first span of each number.

    Spans of one fingerprint are compared lane by lane; where two differ, bytes decide about all.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = stop - start
    value, first, count = lanes(data, start, stop)
    number, pick = numbered(_spans_hash(value, first, count, length))
    like = pick[number]
    same = np.array_equal(length[like], length)
    if same:
        at = np.repeat(first[like] - first, count) + np.arange(len(value))
        same = np.array_equal(value[at], value)
    if not same:
        blob = data.tobytes()
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(blob[a:b], len(seen)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        pick = np.unique(number, return_index=True)[1]
    return number, pick


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, equal where values are equal, and the first place of each number."""
    coded = pa.array(values).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    pick = np.empty(len(coded.dictionary), np.int64)
    pick[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, pick


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hash of every n consecutive fingerprints: one multiply-add per word for each step of n."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:count].copy()
        for k in range(1, n):
            out *= BASE
            out += h[k : k + count]
        return splitmix(out)


def spans(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The rolling hash of ``windows`` at some places only."""
    with np.errstate(over="ignore"):
        out = h[at]
        for k in range(1, n):
            out *= BASE
            out += h[at + k]
        return splitmix(out)
