"""Robust statistics and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_median(x: Column) -> Column:
    """The value at position n // 2 of the sorted values: with an even number, the upper of the middle two."""
    every = F.array_sort(F.collect_list(x))
    return F.get(every, F.floor(F.size(every) / 2).cast("int"))


def median_and_spread(rows: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """n, median and median absolute deviation (``mad``) per key, for keys with at least ``least`` values."""
    first = rows.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median")).filter(F.col("n") >= least)
    away = rows.join(first, by).groupBy(*by).agg(F.first("n").alias("n"), F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return away


def reference_values(rows: DataFrame, by: list[str], value: str, least: int = 3, spread: float = 0.15, floor: float = 0.05) -> DataFrame:
    """Median and spread per key, only where occurrences are many and steady enough to be a reference."""
    out = median_and_spread(rows, by, value, least)
    return out.filter((F.col("median") > floor) & (F.col("mad") / F.col("median") <= spread))


def error_figures(error: Column) -> list[Column]:
    """n, mean, median and largest error; zeros for none."""
    return [F.count(error).alias("n"), F.coalesce(F.avg(error), F.lit(0.0)).alias("avg"), F.coalesce(F.median(error), F.lit(0.0)).alias("med"), F.coalesce(F.max(error), F.lit(0)).alias("max")]


def share_within(error: Column, limit: float) -> Column:
    return F.avg((error <= limit).cast("double"))
