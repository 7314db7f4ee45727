"""Streaming twins: sessions by pause, idempotent publishing, lease expiry, running speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def sessions(events: DataFrame, by: str, at: str, pause: str, late: str = "1 day") -> DataFrame:
    """Spans of events of a key that follow within the pause."""
    w = F.session_window(at, pause)
    out = events.withWatermark(at, late).groupBy(by, w).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def published(jobs: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each id once, as long as the watermark remembers it."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def speeds(events: DataFrame, worker: str, kind: str, seconds: str) -> DataFrame:
    """Count and sum of the seconds per worker and class, in update mode."""
    return events.groupBy(worker, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds"))


def stale_claims(claims: DataFrame, beats: DataFrame, now, silence: float) -> DataFrame:
    """Claims whose worker was silent for longer than ``silence`` seconds (a batch over both tables)."""
    last = beats.groupBy("worker").agg(F.max("at").alias("seen"))
    return claims.join(last, "worker", "left").filter(F.coalesce(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("seen") > silence, F.lit(True)))


def active_workers(beats: DataFrame, within: float) -> DataFrame:
    """Last status of every worker heard of within some seconds of the newest beat."""
    newest = beats.agg(F.max("at").alias("newest"))
    last = beats.groupBy("worker").agg(F.max("at").alias("seen"), F.max_by("status", "at").alias("status"))
    return last.crossJoin(F.broadcast(newest)).filter(F.unix_timestamp("newest") - F.unix_timestamp("seen") <= within).drop("newest")
