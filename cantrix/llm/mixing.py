"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets the rate of least relative entropy that meets its source's token constraint
within [0, ceiling]: ``min(ceiling, exp(lambda * size))``, with one multiplier for each source.
The dual is convex; safeguarded Newton steps run as aggregations over the histogram of
(source, size), which does not grow with copies of a size. Rates become whole copies by cumulative
rounding along descending sizes, then single cells closest to the remaining error are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import cut, drop

#: Documents of one (source, size) that are ranked in one sort.
GROUP = 128
WORDS = r"[^\x20\x09-\x0D]+"


def _numbered(totals: DataFrame) -> DataFrame:
    """``totals`` with ``place``, the number of each source in code point order from 0, null last; no task sorts all of them."""
    order = F.col("source").asc_nulls_last()
    parts = cut(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    held = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each partition
    before, at = {}, 0
    for r in held:
        before[r["part"]], at = at, at + r["n"]
    first = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("place", F.element_at(first, F.col("part")) + own).drop("part")


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """source, source_size, target: by weight, none above ``ceiling`` times its size, the excess reshared.

    ``totals`` has a row for each source. Every round gives what is left to the sources below their cap,
    by weight, and ends when that takes none of them above it: a few aggregations, each of two numbers.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    t = cut(_numbered(totals).select("source", "source_size", w.alias("w"), (ceiling * F.col("source_size")).alias("cap")))
    level, seen = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        got = t.agg(F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if got["n"] == seen or not got["open"]:
            break  # no source has come to its cap since the last round, or all have
        seen, level = got["n"], (share * got["all"] - (got["full"] or 0.0)) / got["open"]
    top = F.col("cap") if not got["open"] else F.least("cap", F.lit(level) * F.col("w"))
    return t.select("source", "source_size", top.alias("target"))


def _rate(x: Column, multiplier: Column, ceiling: float) -> Column:
    return F.least(F.lit(ceiling), F.exp(F.least(multiplier * x, F.lit(50.0))))


#: First multipliers that are tried, in units of one mean document; later ones lie within the bracket found.
START = (-50.0, -10.0, -4.0, -2.0, -1.0, -0.5, -0.2, 0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 20.0, 100.0, 1000.0)
BETWEEN = 6


def multipliers(hist: DataFrame, goals: DataFrame, ceiling: float, steps: int, tolerance: float) -> DataFrame:
    """goals with the multiplier of each source; null where every rate is the ceiling.

    Every step evaluates the dual's gradient at a few multipliers in one aggregation, narrows the
    bracket, and adds the Newton point of the best one.
    """
    bounded = (F.col("source_size") > 0) & (F.col("target") < ceiling * F.col("source_size"))
    start = F.array(*(F.lit(float(x)) for x in START))
    state = cut(goals.withColumn("tried", F.when(bounded, start)).withColumn("low", F.lit(START[0])).withColumn("high", F.lit(START[-1])).withColumn("lam", F.when(bounded, F.lit(0.0))))
    n = len(START)
    for _ in range(steps):
        x = F.col("size") / F.col("mean_size")
        each = []
        for k in range(n):
            rate = _rate(x, F.col("tried")[k], ceiling)
            mass = F.col("cnt") * F.col("size") * rate
            each += [F.sum(mass).alias(f"g{k}"), F.sum(F.when(rate < ceiling, mass * x).otherwise(0.0)).alias(f"s{k}")]
        cells = hist.join(state.filter("lam is not null").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        seen = cells.groupBy("_s").agg(*each)
        seen = seen.select("_s", F.array(*(F.struct(F.col(f"g{k}").alias("g"), F.col(f"s{k}").alias("slope")) for k in range(n))).alias("got"))
        moved = state.join(seen, F.col("source").eqNullSafe(F.col("_s")), "left")
        points = F.transform(F.arrays_zip("tried", "got"), lambda p: F.struct(p["tried"].alias("lam"), p["got"]["g"].alias("g"), p["got"]["slope"].alias("slope")))
        moved = moved.withColumn("p", points)
        best = F.array_min(F.transform("p", lambda p: F.struct(F.abs(p["g"] / F.col("target") - 1).alias("off"), p["lam"].alias("lam"), p["g"].alias("g"), p["slope"].alias("slope"))))
        low = F.greatest("low", F.array_max(F.transform(F.filter("p", lambda p: p["g"] <= F.col("target")), lambda p: p["lam"])))
        high = F.least("high", F.array_min(F.transform(F.filter("p", lambda p: p["g"] > F.col("target")), lambda p: p["lam"])))
        moved = moved.select("source", "source_size", "n_docs", "mean_size", "target", low.alias("low"), high.alias("high"), best.alias("b"))
        newton = F.col("b.lam") - (F.col("b.g") - F.col("target")) / F.greatest(F.col("b.slope"), F.lit(1e-300))
        newton = F.greatest("low", F.least("high", newton))
        inner = [F.col("low") + (F.col("high") - F.col("low")) * (k / (BETWEEN + 1)) for k in range(1, BETWEEN + 1)]
        moved = moved.withColumn("tried", F.when(F.col("b").isNotNull(), F.array(newton, *inner)))
        n = 1 + BETWEEN
        before, state = state, cut(moved.select("source", "source_size", "n_docs", "mean_size", "target", "low", "high", "tried", F.col("b.lam").alias("lam"), F.col("b.off").alias("off")))
        drop(before)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            break
    return state


def rounded(hist: DataFrame, solved: DataFrame, ceiling: float, moves: int = 3) -> DataFrame:
    """source, size, cnt, target, source_size and the whole number of copies that each cell takes."""
    s = solved.select(F.col("source").alias("_s"), "source_size", "target", "mean_size", "lam")
    rate = F.when(F.col("lam").isNull(), F.lit(ceiling)).otherwise(_rate(F.col("size") / F.greatest(F.col("mean_size"), F.lit(1e-9)), F.col("lam"), ceiling))
    cells = hist.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate)
    along = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("cnt") * F.col("rate")).over(along)
    copies = F.floor(upto + 0.5) - F.floor(upto - F.col("cnt") * F.col("rate") + 0.5)
    cells = cut(cells.withColumn("copies", F.greatest(F.lit(0), F.least(copies, (ceiling * F.col("cnt")).cast("bigint")))).select("source", "size", "cnt", "source_size", "target", "copies"))
    for _ in range(moves):
        error = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("error")).withColumnRenamed("source", "_s")
        open_ = F.when(F.col("error") > 0, F.col("copies") < F.floor(ceiling * F.col("cnt"))).otherwise(F.col("copies") > 0)
        after = F.abs(F.abs(F.col("error")) - F.col("size"))
        better = open_ & (F.col("size") > 0) & (after < F.abs(F.col("error")))
        near = cells.join(error, F.col("source").eqNullSafe(F.col("_s"))).filter(better)
        pick = near.groupBy("_s").agg(F.min(F.struct(after.alias("after"), "size", F.signum("error").alias("sign"))).alias("p"))
        pick = pick.select("_s", F.col("p.size").alias("_size"), F.col("p.sign").cast("bigint").alias("_sign"))
        joined = cells.join(pick, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
        cells = cut(joined.withColumn("copies", F.col("copies") + F.coalesce("_sign", F.lit(0))).drop("_s", "_size", "_sign"))
    return cells


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: int = 2, steps: int = 20, tolerance: float = 1e-6, text: str = "text", key: str = "doc_id", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``key``, size, source_size, target, copies, taken (copies times size) of each row, and ``keep``.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0). Sources take the weights in code
    point order, null as a source of its own and last; all targets sum to ``share`` of all sizes, and
    none is above ``ceiling`` times its source's size. Documents of size 0 take 0 words; no document
    has more than ``ceiling`` copies. Rows with equal or null key are rows of their own, told apart by their
    texts. A very long text is one size like any other. Columns other than ``keep``, whatever their names,
    are not read. The result depends on the rows alone, not on their order or partitions. An empty table
    gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_text"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep or [])))
    narrow = rows if keep else cut(rows)
    hist = cut(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("cnt")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("cnt")).alias("source_size"), F.sum("cnt").alias("n_docs"))
    goals = targets(totals, weights, share, float(ceiling)).withColumnRenamed("source", "_s")
    goals = goals.join(totals.drop("source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("mean_size", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    cells = rounded(hist, multipliers(hist, goals, float(ceiling), steps, tolerance), float(ceiling))
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "cnt", "source_size", "target", F.col("copies").alias("_all"))

    # large cells are ranked in parts, by a hash of key and text
    joined = narrow.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")))
    joined = joined.withColumn("_part", F.pmod(F.xxhash64(F.col("_key").cast("string"), "size", "_text"), F.ceil(F.col("cnt") / GROUP)).cast("int")).withColumn("_at", F.xxhash64(F.col("_key").cast("string"), F.lit(1)))
    same = ["_src", "size", "_part"]
    joined = joined.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("_s", "_size")
    parts = joined.filter(F.col("cnt") > GROUP).groupBy(*same).agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy("_src", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*same, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy(*same).orderBy("_at", F.col("_key").cast("string"), "_text")
    ranked = joined.withColumn("_rank", F.row_number().over(order) - 1).join(parts, same, "left")
    rank = F.col("_rank") + F.coalesce("_before", F.lit(0))
    copies = F.floor(F.col("_all") / F.col("cnt")) + F.when(rank < F.col("_all") % F.col("cnt"), 1).otherwise(0)
    out = ranked.withColumn("copies", copies.cast("bigint"))
    return out.select(F.col("_key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])))
