"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over a text's words; characters of words inside n-grams
that occur again, and of lines equal to an earlier line, are measured against all characters.
Limits follow published repetition rules for web text: shares of characters in duplicated 5- to
10-grams, in the commonest 2- to 4-gram, and in duplicated lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .arrow import add_columns, sums
from .textbuf import Texts, distinct, numbered, spans, splitmix, words

#: The signs that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Limits:
    """A text fails where a share is above its limit."""

    least_words: int = 20
    window: int = 8
    repeated_share: int = 30
    duplicated: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    commonest: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    line_share: float = 0.20


def _groups(h: np.ndarray, at: np.ndarray, n: int, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each window of n words (``at`` where it starts), the groups' sizes and first members."""
    group, first = numbered(h)
    size = np.bincount(group, minlength=len(first))
    twice = np.flatnonzero(size[group] > 1)
    a, b = at[twice], at[first[group[twice]]]
    if not ((row[a] == row[b]).all() and all((number[a + k] == number[b + k]).all() for k in range(n))):  # 2**-64 a pair
        exact = np.stack([row[at], *(number[at + k] for k in range(n))], 1)
        _, first, group, size = np.unique(exact, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return group, size, first


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that starts at one of ``at``."""
    step = np.bincount(at, minlength=n_words + 1) - np.bincount(at + n, minlength=n_words + 1)
    return np.cumsum(step[:n_words]) > 0


def measure(t: Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All figures of a chunk, an array for each."""
    w = words(t)
    lead = (t.data & 0xC0) != 0x80
    points = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    chars = points[w.stop] - points[w.start]
    n_words = np.diff(w.first)
    word_chars = sums(chars, w.first)
    symbols = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(SYMBOLS[t.data], out=symbols[1:])
    n_symbols = symbols[t.offsets[1:]] - symbols[t.offsets[:-1]]

    rows = len(t)
    repeat_words = np.zeros(rows, np.int64)
    shares = {f"dup_{n}gram_share": np.zeros(rows) for n in limits.duplicated} | {f"top_{n}gram_share": np.zeros(rows) for n in limits.commonest}
    some = np.maximum(word_chars, 1)
    number = distinct(t.data, w.start, w.stop)[0]
    salt = splitmix(w.row)
    inside = lambda at, n: sums(np.where(covered(len(w.row), at, n), chars, 0), w.first)
    at, room = np.arange(len(w.row)), w.first[1:][w.row] if len(w.row) else np.zeros(0, np.int64)
    # a window that repeats starts with a shorter one that repeats, so each length looks only there
    for n in sorted({limits.window, *limits.duplicated, *limits.commonest}):
        at = at[at + n <= room[at]]
        if not len(at):
            break
        group, count, first = _groups(spans(w.hash, at, n) ^ salt[at], at, n, number, w.row)
        if n in limits.commonest:
            many = np.flatnonzero(count > 1)
            of_row = w.row[at[first[many]]]
            order = np.lexsort((first[many], -count[many], of_row))
            best = many[order[np.unique(of_row[order], return_index=True)[1]]]
            chosen = np.zeros(len(count), bool)
            chosen[best] = True
            shares[f"top_{n}gram_share"] = inside(at[chosen[group]], n) / some
        at = at[count[group] > 1]
        if n in limits.duplicated:
            shares[f"dup_{n}gram_share"] = inside(at, n) / some
        if n == limits.window:
            repeat_words = sums(covered(len(w.row), at, n).astype(np.int64), w.first)
    dup_lines, dup_line_chars = _lines(t, w, chars)
    failed = (n_words < limits.least_words) | (100 * repeat_words > limits.repeated_share * n_words)
    line_share = dup_line_chars / some
    bad = line_share > limits.line_share
    for n, most in limits.duplicated.items():
        bad |= shares[f"dup_{n}gram_share"] > most
    for n, most in limits.commonest.items():
        bad |= shares[f"top_{n}gram_share"] > most
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~(failed | bad), "dup_line_share": line_share, **shares}


def _lines(t: Texts, w, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the lines with a word that equal an earlier line of it, and the characters of their words."""
    newline = np.flatnonzero(t.data == 10)
    of_row = np.diff(np.searchsorted(newline, t.offsets))
    start, stop = np.sort(np.concatenate([t.offsets[:-1], newline + 1])), np.sort(np.concatenate([t.offsets[1:], newline]))
    row = np.repeat(np.arange(len(t)), of_row + 1)
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, stop)
    has = last > first
    row, first, last = row[has], first[has], last[has]
    number, _ = distinct(t.data, start[has], stop[has])
    repeated = np.ones(len(row), bool)
    repeated[numbered(row * (len(row) + 1) + number)[1]] = False
    total = np.concatenate([[0], np.cumsum(chars)])
    size = (total[last] - total[first])[repeated]
    return np.bincount(row[repeated], minlength=len(t)), np.bincount(row[repeated], weights=size, minlength=len(t)).astype(np.int64)


def quality_rules(docs: DataFrame, limits: Limits | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Base counts, repetition shares and the verdict ``kept`` of each row.

    A null or empty text has no word: counts 0, base_failed true, kept false. Words are
    ``[^\\x20\\x09-\\x0D]+``; windows and n-grams are compared word by word after their hashes.
    Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    limits = limits or Limits()
    shares = [f"dup_{n}gram_share" for n in limits.duplicated] + [f"top_{n}gram_share" for n in limits.commonest]
    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"{x} double" for x in shares)
    return add_columns(docs, text, [key], schema, lambda: lambda t: measure(t, limits))
