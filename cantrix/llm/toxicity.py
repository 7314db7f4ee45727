"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the openings of longer words, hashed. The machine's pairwise
part scores that two terms meet in one text, which additive weights cannot: insult with group mention.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import TEXT, add_columns, crc_mod, sums
from .textbuf import LOWER, NOT_ALNUM, Texts, chunks, span_hash, splitmix, words


@dataclass(frozen=True)
class Setting:
    """Bounds of the labelled sample: ``fit_rows`` labels, chosen by a hash of their id, with one text of at most ``fit_chars`` characters each."""

    fit_rows: int = 12_000
    fit_chars: int = 200_000
    bits: int = 20
    opening: int = 5
    features: int = 1024
    frequent: int = 256
    rank: int = 4
    epochs: int = 40
    batch: int = 512
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7


def terms(t: Texts, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms sorted by row, and their rows."""
    w = words(t, NOT_ALNUM, lower=True)
    long = np.flatnonzero(w.stop - w.start > setting.opening)
    opening = span_hash(LOWER[t.data], w.start[long], w.start[long] + setting.opening)
    h = np.concatenate([w.hash, splitmix(opening)]) >> np.uint64(64 - setting.bits)
    row = np.concatenate([w.row, w.row[long]]).astype(np.int64)
    both = np.unique((row << setting.bits) | h.astype(np.int64))
    return both & ((1 << setting.bits) - 1), both >> setting.bits


class Machine:
    """score = sigmoid(bias + sum w + 1/2 sum ((sum v)^2 - sum v^2)) over the terms present."""

    def __init__(self, setting: Setting, number: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.setting, self.number, self.bias, self.w, self.v = setting, number, bias, w, v

    def score(self, t: Texts) -> np.ndarray:
        term, row = terms(t, self.setting)
        at = self.number[term]
        at, row = at[at >= 0], row[at >= 0]
        first = np.searchsorted(row, np.arange(len(t) + 1))
        y = self.bias + sums(self.w[at], first)
        for v in self.v.T:
            y += (sums(v[at], first) ** 2 - sums(v[at] ** 2, first)) / 2
        return 1 / (1 + np.exp(-np.clip(y, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, setting: Setting, rows, text: str, key: str, label: str) -> pa.Table:
    known = labels.filter(rows).filter(F.col(f"`{label}`").isNotNull())
    known = known.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_label").limit(setting.fit_rows)

    def run(batches):
        for b in batches:
            for t in chunks(b.column(1)):
                term, row = terms(t, setting)
                cuts = np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), lists], ["label", "terms"])

    own = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias(TEXT)).filter(F.coalesce(F.length(TEXT), F.lit(0)) <= setting.fit_chars)
    own = own.join(F.broadcast(known), "_id")  # at most fit_rows ids
    # an id that several rows have gives its first text by hash, one for each of its labels
    place = F.row_number().over(Window.partitionBy("_id", "_label").orderBy(F.xxhash64(TEXT), TEXT))
    own = own.withColumn("_place", place).filter("_place = 1").select("_label", TEXT)
    return own.mapInArrow(run, "label int, terms array<int>").toArrow()


def fit(docs: DataFrame, labels: DataFrame, setting: Setting, rows, text: str, key: str, label: str) -> Machine:
    """Train on the bounded sample; rows come in an order of their own, so reruns agree."""
    got = _sample(docs, labels, setting, rows, text, key, label)
    y = got["label"].to_numpy().astype(np.float32)
    lists = got["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cuts, flat = (lists.offsets.to_numpy(), lists.values.to_numpy()) if len(y) else (np.zeros(1, int), np.zeros(0, int))
    owner = np.repeat(np.arange(len(y)), np.diff(cuts))
    flat = flat[cuts[0] : cuts[-1]]
    number = np.full(1 << setting.bits, -1, np.int32)
    yes = (y > 0).astype(np.float32)
    size = 1 << setting.bits
    of_yes, of_all = np.bincount(flat, weights=yes[owner], minlength=size), np.bincount(flat, minlength=size)
    share = float(yes.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Machine(setting, number, -8.0 if share == 0 else 8.0, np.zeros(1), np.zeros((1, setting.rank)))
    # terms that differ between the labels, and the most frequent ones for pairs
    z = np.abs(of_yes - of_all * share) / np.sqrt(np.maximum(of_all * share * (1 - share), 1e-9))
    z[of_all < 4] = 0
    strong = np.argsort(-z, kind="stable")[: setting.features - setting.frequent]
    chosen = np.union1d(strong[z[strong] > 4], np.argsort(-of_all, kind="stable")[: setting.frequent])
    number[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    at = number[flat]
    x[owner[at >= 0], at[at >= 0]] = 1
    order = np.lexsort((yes, splitmix(x @ np.arange(1, len(chosen) + 1).astype(np.float64)).astype(np.uint64)))
    x, yes = x[order], yes[order]
    rng = np.random.default_rng(setting.seed)
    theta = [np.full(1, np.log(share / (1 - share)), np.float32), np.zeros(len(chosen), np.float32), rng.normal(0, 0.01, (len(chosen), setting.rank)).astype(np.float32)]
    m, s, step = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for _ in range(setting.epochs):
        for part in np.array_split(rng.permutation(len(yes)), max(1, len(yes) // setting.batch)):
            a, b = x[part], yes[part]
            bias, w, v = theta
            av = a @ v
            score = bias[0] + a @ w + 0.5 * ((av**2).sum(1) - (a @ (v**2)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - b) / len(b)
            ga = a.T @ g
            grads = [np.array([g.sum()]), ga + setting.decay * w, a.T @ (g[:, None] * av) - ga[:, None] * v + setting.decay * v]
            step += 1
            for p, gr, mm, ss in zip(theta, grads, m, s, strict=True):  # Adam
                mm += 0.1 * (gr - mm)
                ss += 0.001 * (gr**2 - ss)
                p -= setting.rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.999**step)) + 1e-8)
    bias, w, v = (p.astype(np.float64) for p in theta)
    return Machine(setting, number, float(bias[0]), w, v)


def toxicity(docs: DataFrame, labels: DataFrame, setting: Setting | None = None, held_out: tuple[int, int] = (5, 0), text: str = "text", key: str = "doc_id", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """``key``, held_out, score, predicted of each row (and the columns ``keep``).

    Labels of rows whose crc32 of ``key`` as text leaves ``held_out[1]`` modulo ``held_out[0]`` are
    never learned from, nor are null labels. A score sees the text alone; an empty or null text has
    the score of no terms, a very long one the score of all its terms. With labels of one kind only, every
    score is near that kind. Repeated rows give repeated results; an id with several labels is learned from
    once with each; columns other than ``keep`` are not read; an empty table gives no rows.
    """
    setting = setting or Setting()
    fold = F.coalesce(crc_mod(f"`{key}`", held_out[0]) == held_out[1], F.lit(False))
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, setting, ~fold, text, key, label))

    def of():
        def each(t):
            score = machine.value.score(t)
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return each

    names = [key, *(c for c in keep or [] if c != key)]
    out = add_columns(docs, text, names, "score double, predicted int", of)
    return out.select(*(F.col(f"`{c}`") for c in names), fold.alias("held_out"), "score", "predicted")
