"""Language identification with bit-sliced Bloom filters of n-grams.

All languages share one filter whose cells are bit masks: one lookup, the bitwise and of a few
cells, returns every language that contains an n-gram. Hits are counted per language over a whole
text, the expected false positives of that language's bits are taken off, and the largest rate decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import add_columns, crc_mod, sums
from .textbuf import BASE, LOWER, U64, Texts, chunks, splitmix

#: Bytes that stay; all other ASCII bytes are one separator.
KEPT = np.full(256, 0x20, np.uint8)
KEPT[0x61:0x7B] = np.arange(0x61, 0x7B)
KEPT[0x80:] = np.arange(0x80, 0x100)
UNKNOWN = "und"


@dataclass(frozen=True)
class Setting:
    """Bounds of the labelled sample: ``fit_rows`` distinct texts of each language, of at most ``fit_chars`` characters, for ``fit_names`` languages."""

    grams: tuple[int, ...] = (3, 5)
    fit_rows: int = 1500
    fit_chars: int = 20_000
    fit_names: int = 256
    cells: int = 1 << 20
    hashes: int = 3
    most_grams: int = 30_000
    share: float = 0.25


def grams(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n bytes from each byte on, and where each row's begin; n-grams never leave a text."""
    data = KEPT[LOWER[t.data]]
    v = splitmix(data.astype(U64) | U64(n << 8))
    count = max(len(data) - n + 1, 0)
    with np.errstate(over="ignore"):
        h = v[:count].copy()
        for k in range(1, n):
            h *= BASE
            h += v[k : k + count]
    ends = np.repeat(t.offsets[1:], np.diff(t.offsets))[:count]
    inside = np.arange(count) + n <= ends
    row = np.repeat(np.arange(len(t)), np.diff(t.offsets))[:count][inside]
    return splitmix(h[inside]), np.searchsorted(row, np.arange(len(t) + 1))


class Filters:
    """Bit-sliced Bloom filter: ``table[word, cell]`` has a bit for each language."""

    def __init__(self, setting: Setting, names: list[str]) -> None:
        self.setting, self.names = setting, names
        self.table = np.zeros((-(-max(len(names), 1) // 64), setting.cells), U64)

    def cells(self, h: np.ndarray):
        for k in range(self.setting.hashes):
            yield ((h >> U64(21 * k)) % U64(self.setting.cells)).astype(np.int64)

    def add(self, number: int, h: np.ndarray) -> None:
        for at in self.cells(h):
            self.table[number // 64, at] |= U64(1) << U64(number % 64)

    def seal(self) -> None:
        fill = [np.mean((self.table[i // 64] >> U64(i % 64)) & U64(1)) for i in range(len(self.names))]
        self.false = np.array(fill) ** self.setting.hashes

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        out = None
        for at in self.cells(h):
            got = [w[at] for w in self.table]
            out = got if out is None else [a & b for a, b in zip(out, got, strict=True)]
        return out

    def rates(self, t: Texts) -> np.ndarray:
        """Share of each row's n-grams in each language, without the expected false positives."""
        hits, total = np.zeros((len(t), len(self.names))), np.zeros(len(t))
        for n in self.setting.grams:
            h, first = grams(t, n)
            masks = self.masks(h)
            total += np.diff(first)
            for i in range(len(self.names)):
                hits[:, i] += sums((masks[i // 64] >> U64(i % 64)).astype(np.uint8) & 1, first)
        rate = hits / np.maximum(total, 1)[:, None]
        return np.maximum(rate - self.false, 0) / (1 - self.false)

    def predict(self, t: Texts) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(t), np.zeros(len(t))
        rate = self.rates(t)
        best = rate.argmax(1)
        score = rate.max(1) / np.maximum(rate.sum(1), 1e-12)
        has = letters(t)
        score = np.where(has, np.clip(score, 0, 1), 0.0)
        return [self.names[b] if x else UNKNOWN for b, x in zip(best.tolist(), has.tolist(), strict=True)], score


def letters(t: Texts) -> np.ndarray:
    """Whether each row has a letter of any script."""
    low = LOWER[t.data]
    first = t.offsets
    out = sums(((low >= 0x61) & (low <= 0x7A)).astype(np.int64), first) > 0
    wide = sums((t.data >= 0x80).astype(np.int64), first) > 0
    for i in np.flatnonzero(wide & ~out).tolist():
        out[i] = any(map(str.isalpha, t.raw(i).decode()))
    return out


def learn(docs: DataFrame, setting: Setting, text: str, label: str, rows) -> Filters:
    """Filters from a bounded sample of the rows that ``rows`` selects: whole texts, chosen by a hash of their words."""
    known = docs.filter(rows).filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= setting.fit_chars))
    known = known.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    # the commonest names; copies of a text share its chance and count once, so the sample is bounded whatever repeats
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(setting.fit_names)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    names = sorted(counts)
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rate = F.lit(None).cast("double")
    for name in names:
        rate = F.when(F.col("lang") == name, F.lit(setting.fit_rows / counts[name])).otherwise(rate)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "text"))
    some = known.withColumn("chance", chance).filter(F.col("chance") < rate * (1 << 40)).distinct()
    sample = some.withColumn("place", place).filter(F.col("place") <= setting.fit_rows).select("lang", "text").toArrow() if names else None
    filters = Filters(setting, names)
    lang = np.array(sample["lang"].to_pylist(), object) if names else np.zeros(0)
    for n in setting.grams:
        seen = []
        for name in names:
            got = [np.unique(h[a:b]) for t in chunks(sample["text"].filter(lang == name)) for h, first in [grams(t, n)] for a, b in zip(first[:-1], first[1:], strict=True)]
            value, count = np.unique(np.concatenate([*got, np.zeros(0, U64)]), return_counts=True)
            seen.append((value, count / max(len(got), 1), count))
        every = np.unique(np.concatenate([x[0] for x in seen])) if seen else np.zeros(0, U64)
        top = np.zeros(len(every))
        for value, rate_, _ in seen:
            at = np.searchsorted(every, value)
            top[at] = np.maximum(top[at], rate_)
        for i, (value, rate_, count) in enumerate(seen):
            # a language contains what at least a share of its texts use, compared with the language that uses it most
            keep = (rate_ >= setting.share * top[np.searchsorted(every, value)]) & (count > 1)
            value, count = value[keep], count[keep]
            filters.add(i, value[np.argsort(-count, kind="stable")[: setting.most_grams]])
    filters.seal()
    return filters


def languages(docs: DataFrame, setting: Setting | None = None, held_out: tuple[int, int] = (4, 2), text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """``key``, held_out, lang_pred, score of each row.

    Rows whose crc32 of ``key`` as text leaves ``held_out[1]`` modulo ``held_out[0]`` are never learned from;
    nor are rows without label or text. Prediction sees the text alone. A text that is null or has no
    letter is "und" with score 0, as is every row where nothing could be learned. Ties go to the first
    name. A very long text is read whole, as a chunk of its own. Repeated rows give repeated results; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    setting = setting or Setting()
    fold = F.coalesce(crc_mod(f"`{key}`", held_out[0]) == held_out[1], F.lit(False))
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs, setting, f"`{text}`", f"`{label}`", ~fold))

    def of():
        def each(t):
            name, score = filters.value.predict(t)
            return {"lang_pred": name, "score": score}

        return each

    out = add_columns(docs, text, [key], "lang_pred string, score double", of)
    return out.select(F.col(f"`{key}`"), fold.alias("held_out"), "lang_pred", "score")
