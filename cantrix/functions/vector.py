"""Vectors and levels as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value made once: inside a lambda an expression runs again for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def standardized(a: Column, floor: float = 1e-8) -> Column:
    """Mean 0 and population deviation 1; the deviation is at least ``floor``."""
    n = F.size(a)

    def scaled(mean: Column) -> Column:
        spread = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
        return _bound(F.greatest(spread, F.lit(floor)), lambda d: F.transform(a, lambda x: (x - mean) / d))

    return _bound(total(F.transform(a, lambda x: x.cast("double"))) / n, scaled)


def rms(a: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(dot(a, a) / F.size(a)))


def decibels(level: Column, floor: float = 1e-7) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(floor)))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def distortion_ratio(reference: Column, estimate: Column) -> Column:
    """10 log10 of reference over error energy; NaN without reference, 100 without error."""
    error = F.aggregate(F.zip_with(reference, estimate, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)
    energy = dot(reference, reference)
    return F.when(energy == 0, F.lit(float("nan"))).when(error == 0, 100.0).otherwise(10 * F.log10(energy / error))


def profile(a: Column) -> Column:
    """Parts of the whole; zeros where the whole is 0."""
    whole = total(a)
    return F.transform(a, lambda x: F.when(whole > 0, x / whole).otherwise(0.0))


def same_shape(a: Column, b: Column) -> Column:
    """Equal lengths, and each pair differs by at most 2 or a quarter of the larger."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.greatest(F.lit(2.0), 0.25 * F.greatest(x, y)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def nearest_of(value: Column, choices: list[float], default: float) -> Column:
    """The listed value nearest to ``value``, the smaller on ties; ``default`` for null."""
    every = F.array(*(F.struct(F.abs(F.lit(c) - value).alias("far"), F.lit(c).alias("choice")) for c in choices))
    return F.when(value.isNull(), F.lit(default)).otherwise(F.array_min(every)["choice"])


def smoothstep(x: Column) -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return x * x * (3 - 2 * x)
