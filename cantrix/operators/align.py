"""Alignment and clustering that depend on row-by-row state: Arrow functions per group, each bounded by one text pair."""

from __future__ import annotations

import collections
import functools
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_and_spaces, sound_forms, sound_key, sound_of, sounds_in

#: Fixed values of the global alignment.
GAP, BASE, MULTI, HALF = 0.15, 0.45, 0.05, 0.3
#: Words of the left and the right text that a step takes, in the order in which equal scores decide.
MOVES = ((2, 1), (1, 2), (1, 1), (1, 0), (0, 1))
#: Pairs of texts that are aligned at once, as far as their tables have that many cells together.
TEXTS, TABLE = 64, 1_000_000
#: What scores may differ by that are the same but for rounding.
EPSILON = 1e-6
#: Letters of texts whose keys are grouped at once, rows and cells of a table of letters in common, and pairs held.
CHUNK, ROWS, CELLS, PAIRS = 2_000_000, 256, 4_000_000, 1_000_000
#: Keys of more letters, or with a letter that is not among so many, are compared one by one.
BITS, LETTERS = 32, 127


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(of, "double")(a, b)


def matching_blocks(a: Column, b: Column) -> Column:
    """Matching blocks of two arrays of words, as structs (a, b, size)."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            found = SequenceMatcher(None, list(p if p is not None else ()), list(q if q is not None else ()), autojunk=False).get_matching_blocks()
            out.append([[m.a, m.b, m.size] for m in found if m.size])
        return pd.Series(out)

    blocks = F.pandas_udf(of, "array<array<int>>")(a, b)
    return F.transform(blocks, lambda m: F.struct(m[0].alias("a"), m[1].alias("b"), m[2].alias("size")))


def same_text(a: Column, b: Column) -> Column:
    """At least 85 % alike."""
    return ratio(a, b) >= 0.85


def levenshtein_similarity(a: str, b: str) -> float:
    """1 - distance / longest, 0 where one is empty."""
    return float(1.0 - _distances([a], [b])[0]) if a and b else 0.0


@functools.lru_cache(maxsize=100_000)
def _unit(key: str) -> str:
    """The shortest unit that the key repeats at least twice, whose start may follow; else the key."""
    return next((key[:n] for n in range(1, len(key) // 2 + 1) if key[n:] == key[:-n]), key)


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of each pair of sound keys, all distances at once: see ``functions.text.key_similarity``."""
    out = np.zeros(len(left))
    a, b = [_unit(x) for x in left], [_unit(x) for x in right]
    far = []
    for k, (x, y, p, q) in enumerate(zip(left, right, a, b, strict=True)):
        if not x or not y:
            continue
        if x == y:
            out[k] = 1.0
        elif p == q:
            out[k] = 0.95
        else:
            short, long = (p, q) if len(p) <= len(q) else (q, p)
            if len(short) >= 3 and short in long:
                out[k] = len(short) / len(long)
            else:
                far.append(k)
    for low in range(0, len(far), 100_000):
        some = far[low : low + 100_000]
        out[some] = 1.0 - _distances([a[k] for k in some], [b[k] for k in some])
    return out


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in keys])
    codes = np.zeros((int(size.max()), len(keys)), np.int32)
    for k, x in enumerate(keys):
        codes[: len(x), k] = [ord(c) for c in x]
    return codes, size


def _distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distance over the longer length, cell by cell of the table and all pairs in one operation."""
    (x, m), (y, n) = _codes(left), _codes(right)
    before = np.repeat(np.arange(len(y) + 1, dtype=np.int16)[:, None], len(left), 1)
    out = np.zeros(len(left))
    for i in range(len(x)):
        now = np.empty_like(before)
        now[0] = i + 1
        for j in range(len(y)):
            now[j + 1] = np.minimum(np.minimum(before[j + 1], now[j]) + 1, before[j] + (x[i] != y[j]))
        done = np.flatnonzero(m == i + 1)
        out[done] = now[n[done], done]
        before = now
    return out / np.maximum(m, n)


def align(left: list[str], right: list[str], similarity=None) -> list[tuple[int, int, float]]:
    """Alignment of two word lists by their sound keys; ``similarity`` compares the words themselves instead."""
    if similarity is None:
        return align_keys([([[sound_of(x)] for x in left], [sound_of(x) for x in right])])[0]
    return align_keys([([[x] for x in left], list(right))], lambda a, b: np.array([similarity(x, y) for x, y in zip(a, b, strict=True)]))[0]


def align_keys(texts: list[tuple[list[list[str]], list[str]]], similarity=None) -> list[list[tuple[int, int, float]]]:
    """Global alignment of each pair of texts: (left, right, similarity) of the words that are coupled.

    A left word has one key or more (a number spelled in several languages), of which the one that fits best
    counts. Each skipped word costs ``GAP``, a couple earns its similarity less ``BASE``. Two joined left
    words may couple with one right word, or one with two, at ``MULTI`` less, where one of the two alone has a
    similarity of ``HALF`` at least. Of equal scores the first move of ``MOVES`` wins.

    Couples whose letters in common show that other moves over the same words earn more are left out.
    """
    number: dict[str, int] = {}
    of = lambda x: number.setdefault(x, len(number))
    lefts = [np.array([of(forms[0]) for forms in x], np.int64) for x, _ in texts]
    more = [[(i, f, of(forms[f])) for i, forms in enumerate(x) for f in range(1, len(forms))] for x, _ in texts]
    rights = [np.array([of(w) for w in y], np.int64) for _, y in texts]
    left_two = [np.array([of(a[0] + b[0]) for a, b in zip(x, x[1:], strict=False)], np.int64) for x, _ in texts]
    right_two = [np.array([of(a + b) for a, b in zip(y, y[1:], strict=False)], np.int64) for _, y in texts]
    # a word of several forms is joined in each
    forms_two = [{(i, f, g): of(p + q) for i in {w + k for w, *_ in m for k in (-1, 0)} if 0 <= i < len(x) - 1 for f, p in enumerate(x[i]) for g, q in enumerate(x[i + 1])} for m, (x, _) in zip(more, texts, strict=True)]
    names = list(number)
    keys = _Keys(names) if similarity is None and names else None
    sim = keys.similar if keys else lambda a, b: np.asarray(similarity([names[k] for k in a.tolist()], [names[k] for k in b.tolist()]), float) if len(a) else np.zeros(0)
    most = keys.common if keys else lambda a, b: np.full((len(a), len(b)), np.inf)

    many, rows, cols = len(texts), max(map(len, lefts), default=0), max(map(len, rights), default=0)
    one, best = np.full((many, rows, cols), -np.inf), {}
    todo = []
    for t, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        one[t, : len(x), : len(y)] = 0.0
        # below this two skipped words cost less
        want = most(x, y) >= BASE - 2 * GAP - EPSILON
        want[[i for i, *_ in more[t]]] = True
        i, j = np.nonzero(want)
        todo.append((np.full(len(i), t), i, j, x[i], y[j]))
    if todo:
        t, i, j, a, b = (np.concatenate(x) for x in zip(*todo, strict=True))
        one[t, i, j] = sim(a, b)
    for t, y in enumerate(rights):
        for i, f, form in more[t]:
            own = sim(np.full(len(y), form), y)
            better = own > one[t, i, : len(y)]
            one[t, i, : len(y)][better] = own[better]
            best.setdefault((t, i), np.zeros(len(y), np.int64))[better] = f
    two_one, one_two = np.full((many, max(rows - 1, 0), cols), -np.inf), np.full((many, rows, max(cols - 1, 0)), -np.inf)
    todo, others = [], []
    for t, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        own, several = one[t, : len(x), : len(y)], sorted({i for i, *_ in more[t]})
        if len(x) > 1 and len(y):
            top = np.maximum(own[:-1], own[1:])
            bound = most(left_two[t], y)
            bound[[i + k for i in several for k in (-1, 0) if 0 <= i + k < len(x) - 1]] = np.inf
            i, j = np.nonzero((top >= HALF) & (bound >= top - (GAP - MULTI) - EPSILON))
            two = left_two[t][i]
            if several:
                none = np.zeros(len(y), np.int64)
                two = np.array([forms_two[t].get((p, best.get((t, p), none)[q], best.get((t, p + 1), none)[q]), w) for p, q, w in zip(i.tolist(), j.tolist(), two.tolist(), strict=True)], np.int64)
            todo.append((np.full(len(i), t), i, j, two, y[j]))
        if len(x) and len(y) > 1:
            # the form of a number is chosen against both right words together
            top = np.maximum(own[:, :-1], own[:, 1:])
            bound = most(x, right_two[t])
            bound[several] = np.inf
            i, j = np.nonzero((top >= HALF) & (bound >= top - (GAP - MULTI) - EPSILON))
            others.append((np.full(len(i), t), i, j, x[i], right_two[t][j]))
            for p, _, form in more[t]:
                j = np.flatnonzero(top[p] >= HALF)
                others.append((np.full(len(j), t), np.full(len(j), p), j, np.full(len(j), form), right_two[t][j]))
    for held, out in ((todo, two_one), (others, one_two)):
        if held:
            t, i, j, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            np.maximum.at(out, (t, i, j), sim(a, b))
    return _paths([(len(x), len(y)) for x, y in zip(lefts, rights, strict=True)], one, two_one, one_two)


def _paths(sizes: list[tuple[int, int]], one: np.ndarray, two_one: np.ndarray, one_two: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """The couples of the best path of each text; the cells of a diagonal are computed at once, for all texts."""
    many, rows, cols = one.shape
    move = np.zeros((rows + 1, cols + 1, many), np.int8)
    sims = {(1, 1): one, (2, 1): two_one, (1, 2): one_two}
    earned = {step: np.ascontiguousarray(np.moveaxis(x, 0, 2)) - BASE for step, x in sims.items()}
    before: list[np.ndarray] = [np.zeros((rows + 1, many))]
    for d in range(1, rows + cols + 1):
        low, high = max(0, d - cols), min(rows, d)
        top, own = np.full((high - low + 1, many), -np.inf), np.zeros((high - low + 1, many), np.int8)
        for number, (di, dj) in enumerate(MOVES):
            # rows i from which i - di and d - i - dj are both there
            a, b = max(low, di), min(high, d - dj)
            if a > b or di + dj > len(before):
                continue
            value = before[-di - dj][a - di : b - di + 1]
            if di and dj:
                i = np.arange(a - di, b - di + 1)
                value = value + earned[di, dj][i, d - di - dj - i]
                if di != dj:
                    value = value - MULTI
            else:
                value = value - GAP
            at = slice(a - low, b - low + 1)
            better = value > top[at]
            np.copyto(top[at], value, where=better)
            own[at][better] = number
        i = np.arange(low, high + 1)
        move[i, d - i] = own
        now = np.full((rows + 1, many), -np.inf)
        now[low : high + 1] = top
        before = [*before[-2:], now]
    out = []
    for t, (i, j) in enumerate(sizes):
        pairs, steps = [], move[: i + 1, : j + 1, t]
        while i or j:
            di, dj = MOVES[steps[i, j]]
            if di and dj:
                s = float(sims[di, dj][t, i - di, j - dj])
                pairs += [(i - 1 - p, j - 1 - q, s) for p in range(di) for q in range(dj)]
            i, j = i - di, j - dj
        out.append(sorted(pairs))
    return out


def aligned(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, left_pos, right_pos, similarity for each couple of words of each row's two arrays, by their sound keys.

    The alignment runs over batches of ``TEXTS`` pairs of texts, each diagonal of the table for all of them at once. A null array is an empty text; an empty text couples with nothing.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            lefts, rights = ([of(*x) for x in zip(pdf[c], sounds_in(pdf[f"{c}_text"].tolist(), "\n"), pdf[f"{c}_n"], strict=True)] for c in ("l", "r"))
            texts = [([[w] if isinstance(w, str) else [f or "" for f in w] for w in x], [w or "" for w in y]) for x, y in zip(lefts, rights, strict=True)]
            # tables of like shape are put together
            order = sorted(range(len(texts)), key=lambda k: (len(texts[k][0]) // 8, len(texts[k][1])))
            names, low = pdf[key].tolist(), 0
            while low < len(order):
                high, rows, cols = low, 0, 0
                while high < min(low + TEXTS, len(order)):
                    x, y = texts[order[high]]
                    rows, cols = max(rows, len(x)), max(cols, len(y))
                    if high > low and rows * cols * (high + 1 - low) > TABLE:
                        break
                    high += 1
                some = order[low:high]
                out = [(names[k], *found) for k, own in zip(some, align_keys([texts[k] for k in some]), strict=True) for found in own]
                yield pd.DataFrame(out, columns=[key, "left_pos", "right_pos", "similarity"])
                low = high

    def of(made, text: list[str], n: int) -> list:
        return list(made) if made is not None else text if n else []

    empty = F.array().cast("array<string>")
    # the work is in the cells, not in the bytes by which partitions would be put together
    texts = pairs.select(key, F.coalesce(left, empty).alias("l"), F.coalesce(right, empty).alias("r")).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [key]
    for c, keys in (("l", sound_forms), ("r", lambda x: sound_key(x, spell_numbers=True))):
        joined = F.array_join(F.transform(c, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(""))), "\n")
        # keys are made for whole texts, but word by word where a number may be spelled
        plain = ~joined.rlike("[0-9]")
        columns += [F.when(~plain, F.transform(c, keys)).alias(c), F.when(plain, F.regexp_replace(F.lower(joined), r"[^\p{L}\n]+", "")).otherwise("").alias(f"{c}_text"), F.size(c).alias(f"{c}_n")]
    return texts.select(*columns).mapInPandas(run, f"{key} {kind}, left_pos int, right_pos int, similarity double")


class _Keys:
    """Distinct sound keys of a batch by number: which of two are as alike as ``threshold``, for many pairs at once.

    Keys are compared by their units, where a contained key is as far as the letters that it lacks; so all
    that decides is the distance, and for units that are equal the fixed 0.95.
    """

    def __init__(self, sounds: list[str], threshold: float = 0.65) -> None:
        self.units = _units(sounds)
        size = self.size = np.fromiter(map(len, self.units), np.int64, len(sounds))
        codes, owner, place = _flat(self.units, size)
        lengths = range(int(size.max(initial=0)) + 1)
        # the largest distance by the longer length; -1 where nothing is near enough
        self.allowed = np.array([_reach(n, threshold) for n in lengths])
        self.least = int(threshold > 0.95)
        #: letters that a key has to have in common with one that is no longer; two that lack more are too far
        self.need = (np.array(lengths) - self.allowed)[size].astype(np.float32)
        bags = np.bincount(owner * 32 + codes % 32, minlength=32 * len(sounds)).reshape(-1, 32)
        bags = bags[:, bags.any(0)]
        # products of these sum up to the letters in common, or to more where one letter stands three times
        self.bag = np.concatenate([bags > 0, bags > 1, np.maximum(bags - 2, 0).sum(1, keepdims=True)], 1).astype(np.float32)
        letters, letter, n = np.unique(codes, return_inverse=True, return_counts=True)
        rank = np.empty(len(letters), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(letters))
        letter, self.letters = rank[letter], min(len(letters), LETTERS)
        self.odd = size > BITS
        self.odd[owner[letter >= LETTERS]] = True
        fit = ~self.odd[owner]
        owner, place, letter = owner[fit], place[fit], letter[fit]
        self.text = np.zeros((len(sounds), BITS), np.uint8)
        self.text[owner, place] = letter
        self.places = np.zeros(len(sounds) * self.letters, np.uint32)
        np.bitwise_or.at(self.places, owner * self.letters + letter, np.uint32(1) << place.astype(np.uint32))

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of keys is."""
        size, other = self.size[a], self.size[b]
        far = self.distances(a, b)
        return (size > 0) & (other > 0) & ((far >= self.least) & (far <= self.allowed[np.maximum(size, other)]) | (a == b))

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``similarities`` of each pair of keys."""
        size, other = self.size[a], self.size[b]
        short, long, far = np.minimum(size, other), np.maximum(np.maximum(size, other), 1), self.distances(a, b)
        out, share = 1.0 - far / long, short / long
        # a contained key lacks the other letters, and only the rounding differs
        for k in np.flatnonzero((far == long - short) & (short >= 3) & (share != out)).tolist():
            x, y = sorted((self.units[a[k]], self.units[b[k]]), key=len)
            if x in y:
                out[k] = share[k]
        out[far == 0] = 0.95
        out[a == b] = 1.0
        out[short == 0] = 0.0
        return out

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Levenshtein distance of each pair of units: all pairs at once along the letters of ``b``, a column of the table in the bits of one number."""
        out = np.zeros(len(a), np.int64)
        odd = self.odd[a] | self.odd[b]
        for k in np.flatnonzero(odd).tolist():
            out[k] = _distance(self.units[a[k]], self.units[b[k]])
        order = np.flatnonzero(~odd)
        order = order[np.argsort(self.size[b[order]].astype(np.uint8), kind="stable")]
        ends = np.searchsorted(self.size[b[order]], np.arange(BITS + 2))
        for length in range(BITS + 1):
            for low in range(ends[length], ends[length + 1], 8192):
                some = order[low : min(low + 8192, ends[length + 1])]
                x, at = a[some], self.text[b[some], :length].T
                base = x * self.letters
                up, down = np.full(len(x), 0xFFFFFFFF, np.uint32), np.zeros(len(x), np.uint32)
                for j in range(length):
                    up, down = _column(self.places[base + at[j]], up, down)
                mask = ((np.uint64(1) << self.size[x].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
                out[some] = length + np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each of ``a`` with each of ``b`` the letters in common over the longer length: no similarity is above it."""
        return (self.bag[a] @ self.bag[b].T) / np.maximum(np.maximum(self.size[a][:, None], self.size[b]), 1)


def _column(same, up, down):
    """The steps down the next column of the table of distances, as bits: where they are +1 and where -1."""
    one = type(up.flat[0])(1) if isinstance(up, np.ndarray) else 1
    x = (((same & up) + up) ^ up) | same
    right, left = down | ~(x | up), up & x
    right, left, y = (right << one) | one, left << one, same | down
    return left | ~(y | right), right & y


def _distance(a: str, b: str) -> int:
    """Levenshtein distance of two strings of any length."""
    places, full = {}, (1 << len(a)) - 1
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    up, down = full, 0
    for c in b:
        up, down = _column(places.get(c, 0), up, down)
        up, down = up & full, down & full
    return len(b) + up.bit_count() - down.bit_count()


def _reach(length: int, threshold: float) -> int:
    low = max(0, int(length * (1.0 - threshold)) - 1)
    return max((d for d in range(low, min(low + 4, length + 1)) if length and 1.0 - d / length >= threshold), default=-1)


def _flat(keys: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all keys in one array, with the number of their key and their place in it."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
    return codes, np.repeat(np.arange(len(keys)), size), np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)


def _units(sounds: list[str]) -> list[str]:
    """``_unit`` of each key; only those are looked at whose second half of a repeated unit begins and ends as the first."""
    size = np.fromiter(map(len, sounds), np.int64, len(sounds))
    codes, owner, place = _flat(sounds, size)
    table, seen = np.zeros((len(sounds), BITS), np.uint32), place < BITS
    table[owner[seen], place[seen]] = codes[seen]
    maybe = size > BITS
    for n in range(1, BITS // 2 + 1):
        maybe |= (size >= 2 * n) & (table[:, n] == table[:, 0]) & (table[:, 2 * n - 1] == table[:, n - 1])
    out = list(sounds)
    for k in np.flatnonzero(maybe).tolist():
        out[k] = _unit(out[k])
    return out


def _near(keys: _Keys, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of places in ``own`` whose letters in common allow it; each pair once.

    Keys are taken by length, so that the longer of two decides and shorter ones than it allows are left out.
    """
    size = keys.size[own]
    order = np.argsort(size, kind="stable")
    size, bag, need = size[order], keys.bag[own[order]], keys.need[own[order]]
    low = 0
    while low < len(own):
        high = min(low + max(16, min(ROWS, CELLS // len(own))), len(own))
        first = int(np.searchsorted(size, need[low]))
        hit = np.flatnonzero(bag[low:high] @ bag[first:high].T >= need[low:high, None])
        i, j = np.divmod(hit, high - first)
        i, j = i + low, j + first
        i, j = order[i[j < i]], order[j[j < i]]
        yield np.maximum(i, j), np.minimum(i, j)
        low = high


def _leads(keys: _Keys, groups: list[np.ndarray]) -> list[np.ndarray]:
    """For each group's keys, in order, the place of the first leader that is alike, or its own."""
    fits: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    start = np.concatenate([[0], np.cumsum([len(x) for x in groups])]).astype(np.int64)
    held = 0

    def decide() -> None:
        a, b, later, earlier = (np.concatenate(x) for x in zip(*waiting, strict=True))
        fit = keys.alike(a, b)
        fits.append((later[fit], earlier[fit]))
        waiting.clear()

    for base, own in zip(start.tolist(), groups, strict=False):
        for later, earlier in _near(keys, own):
            waiting.append((own[later], own[earlier], later + base, earlier + base))
            held += len(later)
            if held >= PAIRS:
                decide()
                held = 0
    if waiting:
        decide()
    lead = np.arange(start[-1])
    if fits:
        later, earlier = (np.concatenate(x) for x in zip(*fits, strict=True))
        order = np.argsort(later * (start[-1] + 1) + earlier)
        later, earlier = later[order], earlier[order]
        who, first = np.unique(later, return_index=True)
        flat, leader = earlier.tolist(), lead.tolist()
        for k, at, end in zip(who.tolist(), first.tolist(), [*first.tolist(), len(later)][1:], strict=True):
            for e in flat[at:end]:
                if leader[e] == e:
                    leader[k] = e
                    break
        lead = np.array(leader)
    return [lead[a:b] - a for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _numbered(texts: Iterable[Iterable[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct keys of all texts, and the texts as numbers of those."""
    number: dict[str, int] = {}
    groups = [np.array([number.setdefault(x, len(number)) for x in text], np.int64) for text in texts]
    return list(number), groups


def leader_of(texts: list[list[str]], threshold: float) -> list[list[str]]:
    """For each text's sounds, in order, the first leader that is similar enough, or the sound itself."""
    sounds, groups = _numbered(texts)
    leads = _leads(_Keys(sounds, threshold), groups) if sounds else groups
    return [[text[k] for k in lead.tolist()] for text, lead in zip(texts, leads, strict=True)]


def leaders_in_texts(songs: DataFrame, by: str, texts: str, threshold: float = 0.65) -> DataFrame:
    """``leaders`` of the words of each row's array of texts, with ``by``: sound, n and leader.

    A row's words stay in it, so that none is shuffled; keys are made for whole texts and compared for many rows at once.
    """
    kind = songs.schema[by].dataType.simpleString()

    def made(keys: list, cleaned: list[str], of: pa.DataType) -> pa.RecordBatch:
        counts = [collections.Counter(x) for x in sounds_in(cleaned)]
        # by falling frequency, then by the key: sorting keeps the order of equals
        sounds, groups = _numbered(sorted(sorted(c), key=c.__getitem__, reverse=True) for c in counts)
        n = [c[s] for c, own in zip(counts, groups, strict=True) for s in map(sounds.__getitem__, own.tolist())]
        leads = _leads(_Keys(sounds, threshold), groups) if sounds else groups
        names, own = pa.array(sounds, pa.string()), np.concatenate([np.zeros(0, np.int64), *groups])
        lead = np.concatenate([np.zeros(0, np.int64), *(g[x] for g, x in zip(groups, leads, strict=True))])
        at = np.repeat(np.arange(len(keys)), [len(x) for x in groups])
        return pa.record_batch([pa.array(keys, of).take(pa.array(at)), names.take(pa.array(own)), pa.array(n, pa.int64()), names.take(pa.array(lead))], [by, "sound", "n", "leader"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys, held, size = batch.schema.field(by).type, [], [], 0
            for key, text in zip(batch.column(by), batch.column("cleaned"), strict=True):
                keys.append(key.as_py())
                held.append(text.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    yield made(keys, held, of)
                    keys, held, size = [], [], 0
            if keys:
                yield made(keys, held, of)

    # the work is in the pairs, not in the bytes by which the scan is cut
    dealt = songs.select(by, texts).repartition(int(songs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    cleaned = letters_and_spaces(F.concat_ws("\n", texts))
    return dealt.select(by, cleaned.alias("cleaned")).mapInArrow(run, f"{by} {kind}, sound string, n bigint, leader string")


def leaders(tokens: DataFrame, by: list[str], threshold: float = 0.65) -> DataFrame:
    """Greedy leader clustering of sound keys within a group: by falling frequency, each key joins the first leader that is similar enough.

    ``tokens`` has ``sound`` and ``n``. The order decides, so a group is one row of arrays; groups are texts.
    Similarities of many groups are computed together.
    """
    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in by)
    each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "sound")))
    groups = tokens.groupBy(*by).agg(each.alias("every"))
    groups = groups.select(*by, F.col("every.sound").alias("sounds"), F.transform("every", lambda x: -x["order"]).alias("n"))
    # the work is in the pairs, not in the bytes by which partitions would be put together
    groups = groups.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), TEXTS):
                some = pdf.iloc[low : low + TEXTS]
                found = leader_of([list(x) for x in some["sounds"]], threshold)
                yield some.assign(leader=found)[[*by, "sounds", "n", "leader"]]

    found = groups.mapInPandas(run, f"{kinds}, sounds array<string>, n array<bigint>, leader array<string>")
    return found.select(*by, F.explode(F.arrays_zip("sounds", "n", "leader")).alias("x")).select(*by, F.col("x.sounds").alias("sound"), "x.n", "x.leader")
