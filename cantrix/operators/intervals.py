"""Interval algebra with window functions. ``by`` names the columns of a track; times are any numbers.

Every window is partitioned by track. A track too large for one task can be cut into epochs first
(``by`` then has the epoch), since merging and grouping are decided by neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import islands


def _order(by: list[str], *cols: str):
    return Window.partitionBy(*by).orderBy(*cols)


def merged(spans: DataFrame, by: list[str], gap: float = 0, keep: list[Column] = ()) -> DataFrame:
    """Union of intervals: a new one begins more than ``gap`` after everything before has ended."""
    w = _order(by, "start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("stop").over(w) + gap, F.lit(True))
    return islands(spans, by, ["start", "stop"], fresh, "_part").groupBy(*by, "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("members"), *keep).drop("_part")


def grouped_by_pause(spans: DataFrame, by: list[str], pause: float, order: list[str], name: str = "part") -> DataFrame:
    """Number rows by runs in which each starts at most ``pause`` after the PREVIOUS row's stop."""
    fresh = F.coalesce(F.col("start") - F.lag("stop").over(_order(by, *order)) > pause, F.lit(True))
    return islands(spans, by, order, fresh, name)


def clipped_length(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Common length of two intervals; 0 where a bound is null."""
    return F.when(start.isNotNull() & stop.isNotNull(), F.greatest(F.least(stop, high) - F.greatest(start, low), F.lit(0))).otherwise(0)


def covered(windows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Per window: covered and uncovered length, by the union of the spans clipped to it.

    The time covered up to a moment is what the spans begun by then are long, less what the last of them has
    left; a window's share is the difference of its two ends. One sweep in time order, no pairs.
    """
    union = merged(spans, by).select(*by, F.col("start").alias("at"), F.lit(0).alias("side"), F.col("stop").alias("end"), (F.col("stop") - F.col("start")).alias("length"))
    none = [F.lit(None).cast(union.schema[c].dataType).alias(c) for c in ("end", "length")]
    own = windows.select(*by, "start", "stop").distinct()
    points = own.select(*by, F.explode(F.array("start", "stop")).alias("at")).distinct()
    every = union.withColumn("asked", F.lit(False)).unionByName(points.select(*by, "at", F.lit(1).alias("side"), *none, F.lit(True).alias("asked")))
    w = _order(by, "at", "side").rowsBetween(Window.unboundedPreceding, 0)
    begun, last = F.coalesce(F.sum("length").over(w), F.lit(0)), F.last("end", True).over(w)
    upto = every.withColumn("upto", begun - F.greatest(F.coalesce(last - F.col("at"), F.lit(0)), F.lit(0))).filter("asked").select(*by, "at", "upto")
    both = own.join(upto.withColumnRenamed("at", "start").withColumnRenamed("upto", "_a"), [*by, "start"]).join(upto.withColumnRenamed("at", "stop").withColumnRenamed("upto", "_b"), [*by, "stop"])
    out = both.select(*by, "start", "stop", (F.col("_b") - F.col("_a")).alias("covered"))
    return out.withColumn("uncovered", F.col("stop") - F.col("start") - F.col("covered"))


def only_in(a: DataFrame, b: DataFrame, by: list[str], least: float = 0) -> DataFrame:
    """Stretches that intervals of ``a`` cover and those of ``b`` do not, longer than or as long as ``least``.

    A sweep over starts and stops: each side's running count of open intervals tells what covers
    the stretch up to the next boundary.
    """

    def edges(df: DataFrame, a_step: int, b_step: int) -> DataFrame:
        up = df.select(*by, F.col("start").alias("at"), F.lit(a_step).alias("da"), F.lit(b_step).alias("db"))
        return up.unionByName(df.select(*by, F.col("stop").alias("at"), F.lit(-a_step).alias("da"), F.lit(-b_step).alias("db")))

    steps = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = _order(by, "at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), (F.sum("da").over(run) > 0).alias("in_a"), (F.sum("db").over(run) > 0).alias("in_b"))
    alone = swept.filter("stop is not null and in_a and not in_b").select(*by, "start", "stop")
    return merged(alone, by).drop("members").filter(F.col("stop") - F.col("start") >= least)


def overlapping(rows: DataFrame, spans: DataFrame, by: list[str], tolerance: float = 0, how: str = "left_semi") -> DataFrame:
    """Rows that overlap some span by more than ``tolerance`` (or, with left_anti, none).

    Some span does if, of those that begin before the row's end, the latest end comes after the row's start:
    one sweep in time order, no pairs. Rows without a time overlap nothing.
    """
    s = spans.select(*by, F.col("start").alias("_at"), F.lit(1).alias("_side"), F.col("stop").alias("_end"))
    asked = rows.withColumn("_at", F.col("stop") - tolerance).withColumn("_side", F.lit(0)).withColumn("_end", F.lit(None).cast(s.schema["_end"].dataType))
    latest = F.max("_end").over(_order(by, "_at", "_side").rowsBetween(Window.unboundedPreceding, -1))
    swept = asked.unionByName(s, allowMissingColumns=True).withColumn("_latest", latest).filter("_side = 0")
    hit = F.coalesce(F.col("_latest") > F.col("start") + tolerance, F.lit(False)) & F.col("_at").isNotNull()
    return swept.filter(hit if how == "left_semi" else ~hit).select(*rows.columns)


def pieces(spans: DataFrame, by: list[str], length: int, overlap: int) -> DataFrame:
    """Fixed pieces of each span that overlap; the last is clipped at its end."""
    step = length - overlap
    at = F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("stop") - 1), F.lit(step).cast("bigint")))
    return spans.select(*by, "stop", at.alias("piece_start")).select(*by, "piece_start", F.least(F.col("piece_start") + length, F.col("stop")).alias("piece_stop"))


def active_windows(frames: DataFrame, by: list[str], share: float, bridge: float, least: float) -> DataFrame:
    """Stretches above a share of the track's peak; short gaps are bridged, then short stretches go.

    ``frames`` has ``at`` and ``level``. A run ends at the first frame below, as its last known time.
    """
    peak = F.max("level").over(Window.partitionBy(*by))
    flagged = frames.withColumn("loud", (F.col("level") >= share * peak) & (peak > 0))
    w = _order(by, "at")
    runs = islands(flagged.withColumn("_next", F.coalesce(F.lead("at").over(w), F.col("at"))), by, ["at"], F.coalesce(F.col("loud") != F.lag("loud").over(w), F.lit(True)), "_run")
    runs = runs.filter("loud").groupBy(*by, "_run").agg(F.min("at").alias("start"), F.max("_next").alias("stop")).drop("_run")
    joined = islands(runs, by, ["start"], F.coalesce(F.col("start") - F.lag("stop").over(_order(by, "start")) >= bridge, F.lit(True)), "_part")
    out = joined.groupBy(*by, "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_part")
    return out.filter(F.col("stop") - F.col("start") >= least)
