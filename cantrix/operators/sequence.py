"""Runs, fills and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def islands(rows: DataFrame, by: list[str], order: list[str], fresh: Column, name: str = "part") -> DataFrame:
    """Number runs of rows: ``fresh`` is true where a run begins. Numbers start at 1 in each track."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_fresh", fresh.cast("int")).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def runs_of_equal(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "part") -> DataFrame:
    """Runs of one value; nulls are equal to each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_v", value)
    fresh = ~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)
    return islands(rows, by, order, fresh, name).drop("_v")


def interpolated(rows: DataFrame, by: list[str], order: str, typical_floor: float = 0.3, typical: float = 2.0) -> DataFrame:
    """Fill (start, stop) of rows without them, run by run.

    Between two known rows the room is shared evenly; a run at the head is backed onto the first
    known row, one at the tail follows the last, each row as long as the UPPER median of the known
    lengths. A track without a known row stays without times.
    """
    w = Window.partitionBy(*by).orderBy(order)
    known = F.col("start").isNotNull()
    length = F.when(known & (F.col("stop") > F.col("start")), F.col("stop") - F.col("start"))
    every = F.array_sort(F.collect_list(length).over(Window.partitionBy(*by)))
    usual = F.greatest(F.coalesce(F.get(every, F.floor(F.size(every) / 2).cast("int")), F.lit(typical)), F.lit(typical_floor))
    rows = rows.withColumn("_usual", usual).withColumn("_left", F.last("stop", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_right", F.first("start", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = islands(rows.withColumn("_known", known), by, [order], F.coalesce(F.col("_known") | F.lag("_known").over(w), F.lit(True)), "_run")
    run = Window.partitionBy(*by, "_run")
    n, k = F.count(F.lit(1)).over(run), F.row_number().over(run.orderBy(order)) - 1
    share = (F.col("_right") - F.col("_left")) / n
    base = F.when(F.col("_left").isNull(), F.col("_right") - (n - k) * F.col("_usual")).when(F.col("_right").isNull(), F.col("_left") + k * F.col("_usual")).otherwise(F.col("_left") + k * share)
    step = F.when(F.col("_left").isNull() | F.col("_right").isNull(), F.col("_usual")).otherwise(share)
    filled = rows.withColumn("_base", base).withColumn("_step", step)
    begin = F.when(F.col("_known"), F.col("start")).when(F.col("_base").isNotNull(), F.greatest(F.lit(0.0), F.col("_base")))
    end = F.when(F.col("_known"), F.col("stop")).when(F.col("_base").isNotNull(), F.greatest(F.lit(0.0), F.col("_base") + F.col("_step")))
    return filled.withColumn("start", begin).withColumn("stop", end).drop("_usual", "_left", "_right", "_known", "_run", "_base", "_step")


def spread_picks(items: Column, distance: float) -> Column:
    """Greedy choice from structs (level, at): strongest first, none nearer than ``distance`` to a chosen one, by time."""
    strongest = F.array_sort(items, lambda a, b: F.when(a["level"] > b["level"], -1).when(a["level"] < b["level"], 1).when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    empty = F.slice(F.transform(items, lambda x: x["at"]), 1, 0)
    return F.array_sort(F.aggregate(strongest, empty, lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k - x["at"]) < distance), kept).otherwise(F.concat(kept, F.array(x["at"])))))


def non_overlapping(items: Column) -> Column:
    """From structs (start, stop) in order: each kept one starts at or after the last KEPT one's stop."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(items, empty, lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["stop"]), F.concat(kept, F.array(x))).otherwise(kept))


def monotonic(items: Column, least: float) -> Column:
    """Each start at or after the stop before it, each at least ``least`` long, in array order."""
    empty = F.slice(items, 1, 0)

    def step(done: Column, x: Column) -> Column:
        before = F.when(F.size(done) == 0, x["start"]).otherwise(F.element_at(done, -1)["stop"])
        start = F.greatest(x["start"], before)
        return F.concat(done, F.array(F.struct(start.alias("start"), F.greatest(x["stop"], start + least).alias("stop"))))

    return F.aggregate(items, empty, lambda done, x: F.when(F.size(done) == 0, F.array(F.struct(x["start"].alias("start"), F.greatest(x["stop"], x["start"] + least).alias("stop")))).otherwise(step(done, x)))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows numbered from 0 in the given order, which no task sorts as a whole.

    Rows are dealt by ranges of the order and written; each range begins at the number of rows before it.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row for each partition
    first, at = {-1: 0}, 0
    for r in sizes:
        first[r["_part"]], at = at, at + r["n"]
    before = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("_part"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, (before + own).cast("bigint")).drop("_part")


def newest(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= keep).drop("_place")
