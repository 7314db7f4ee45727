"""Byte-level BPE over whole batches: pre-tokens by numpy, whole-token shortcut, merges only for the rest.

The pre-token pattern is that of the byte-level vocabulary files (``public_tokenizers.PATTERN``):
contractions, runs of letters, of numbers, of other signs (each with one space before it), and
runs of white space, of which the last character goes to what follows. ``pieces`` finds the same
cuts from the classes of neighbouring code points.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
import tokenizers

from .textbuf import Texts, distinct

LETTER, NUMBER, SPACE, OTHER, EDGE, UNKNOWN = range(6)
#: Suffixes that an apostrophe splits off, as in the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


#: Below this code point the classes of all Unicode versions agree.
SETTLED = 0x0530


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; the last cell is the edge between texts. Later ones are asked for when met."""
    out = np.full(0x110001, UNKNOWN, np.uint8)
    out[:SETTLED] = OTHER
    every = "".join(map(chr, range(SETTLED)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0x110000] = EDGE
    return out


@functools.cache
def library() -> tokenizers.pre_tokenizers.PreTokenizer:
    return tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def settle(c: np.ndarray) -> None:
    """Ask the library for the class of code points whose class depends on the version of Unicode."""
    table = classes()
    for p in np.unique(c[(c >= SETTLED) & (table[c] == UNKNOWN)]).tolist():
        x, split = chr(p), library().pre_tokenize_str
        cut = [b for _, (b, _) in split(f"a{x}1")]
        table[p] = LETTER if cut == [0, 2] else NUMBER if cut == [0, 1] else OTHER if len(split(f"!{x}")) == 1 else SPACE


def code_points(t: Texts) -> np.ndarray:
    """Code points of all texts of a chunk, with an edge after each; offsets by ``edges``."""
    n = len(t.data)
    lead = (t.data & 0xC0) != 0x80
    points = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return np.insert(points, before[t.offsets[1:]], 0x110000)


def cuts(c: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points that end with an edge; edges count as pre-tokens too."""
    k = classes()[c]
    if (k == UNKNOWN).any():
        settle(c)
        k = classes()[c]
    start = np.ones(len(c), bool)
    start[1:] = k[1:] != k[:-1]
    start |= k == EDGE
    # the last character of a run of white space leaves the run, and a plain space joins what follows
    after = np.flatnonzero((k[1:] != SPACE) & (k[1:] != EDGE) & (k[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after] = c[after - 1] != 0x20
    # an apostrophe that starts a pre-token takes a contraction with it
    at = np.flatnonzero(start & (c == 0x27))
    if len(at):
        padded = np.append(c, np.full(3, 0x110000, c.dtype))
        first, second = padded[at + 1], padded[at + 2]
        open_ = np.ones(len(at), bool)
        for suffix in CONTRACTIONS:
            hit = open_ & (first == ord(suffix[0]))
            if len(suffix) == 2:
                hit &= second == ord(suffix[1])
            open_ &= ~hit
            ends = at[hit] + 1 + len(suffix)
            start[at[hit] + 1] = False
            ends = ends[ends < len(c)]
            start[ends] = True
    return np.flatnonzero(start)


class Bpe:
    """Ids or counts of whole texts, equal to those of the tokenizers file of the same vocabulary."""

    def __init__(self, path: str | None = None) -> None:
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = self.prove(ranks)
        self.core._mergeable_ranks = {}  # the merges have their own copy
        self.one = self.core._core_bpe.encode_single_piece

    def prove(self, ranks: dict[bytes, int]) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that the merges bring back to their own single id."""
        out = {}
        names = [(b, i) for b, i in ranks.items() if _text(b) is not None]
        joined = Texts(0, np.frombuffer(b"".join(b for b, _ in names), np.uint8), np.cumsum([0, *(len(b) for b, _ in names)]), np.ones(len(names), bool))
        c = code_points(joined)
        at = cuts(c)
        edge = np.cumsum(c[at] == 0x110000) - (c[at] == 0x110000)
        pieces = np.bincount(edge, minlength=len(names)) - 1
        for (b, i), n in zip(names, pieces.tolist(), strict=True):
            if n == 1 and self.core._encode_single_piece(b) == [i]:
                out[b.decode()] = i
        return out

    def pieces(self, t: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of a chunk, then for each pre-token its number there and its text's row."""
        c = code_points(t)
        at = cuts(c).astype(np.int32)
        length = np.diff(at, append=np.int32(len(c)))
        edge = c[at] == 0x110000
        points = np.ascontiguousarray(c, "<u4").view(np.uint8)
        number, pick = distinct(points, 4 * at.astype(np.int64), 4 * (at + length).astype(np.int64))
        text = np.where(c == 0x110000, 0x20, c).astype(np.uint32).tobytes().decode("utf-32-le")
        stop = (at[pick] + length[pick]).tolist()
        names = [text[a:b] for a, b in zip(at[pick].tolist(), stop, strict=True)]
        return names, number[~edge], (np.cumsum(edge) - edge)[~edge]

    def parts(self, t: Texts) -> Iterator[tuple[Texts, np.ndarray]]:
        """The chunk without special strings, with the row of each part; a special string is a part of None bytes."""
        blob = t.data.tobytes()
        if SPECIAL.encode() not in blob:
            yield t, np.arange(len(t))
            return
        parts, rows = [], []
        for i in range(len(t)):
            for k, x in enumerate(t.raw(i).split(SPECIAL.encode())):
                if k:
                    parts.append(None)
                    rows.append(i)
                parts.append(x)
                rows.append(i)
        yield _special(parts), np.array(rows)

    def count(self, t: Texts) -> np.ndarray:
        """Tokens of each text of the chunk."""
        out = np.zeros(len(t), np.int64)
        for sub, rows in self.parts(t):
            if len(sub.data):
                names, number, row = self.pieces(sub)
                whole, one = self.whole, self.one
                sizes = np.array([1 if x in whole else len(one(x.encode())) for x in names], np.int64)  # the edge's is never used
                out += np.bincount(rows[row], weights=sizes[number], minlength=len(t)).astype(np.int64)
            special = ~sub.valid & (np.diff(sub.offsets) == 0) if sub is not t else np.zeros(len(sub), bool)
            out += np.bincount(rows[special], minlength=len(t))
        return out

    def ids(self, t: Texts) -> list[np.ndarray]:
        """Token ids of each text of the chunk."""
        flat = [np.zeros(0, np.uint32)] * len(t)
        for sub, rows in self.parts(t):
            if not len(sub.data):
                each = [np.zeros(0, np.uint32)] * len(sub)
            else:
                names, number, row = self.pieces(sub)
                whole, one = self.whole, self.one
                got = [(whole[x],) if x in whole else one(x.encode()) for x in names]
                size = np.fromiter(map(len, got), np.int64, len(got))
                first = np.cumsum(size) - size
                table = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
                n = size[number]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                all_ids = table[np.repeat(first[number], n) + inner]
                ends = np.cumsum(np.bincount(row, weights=n, minlength=len(sub)).astype(np.int64))
                each = np.split(all_ids, ends[:-1])
            if sub is t:
                return each
            for i, x in enumerate(each):
                got = np.array([SPECIAL_ID], np.uint32) if not sub.valid[i] else x
                flat[rows[i]] = np.concatenate([flat[rows[i]], got])
        return flat


def _text(b: bytes) -> str | None:
    try:
        return b.decode()
    except UnicodeDecodeError:
        return None


def _special(parts: list[bytes | None]) -> Texts:
    data = np.frombuffer(b"".join(x or b"" for x in parts), np.uint8)
    offsets = np.cumsum([0, *(len(x or b"") for x in parts)])
    return Texts(0, data, offsets, np.array([x is not None for x in parts]))


@functools.cache
def shared(path: str | None = None) -> Bpe:
    """One instance for each Python worker."""
    return Bpe(path)
