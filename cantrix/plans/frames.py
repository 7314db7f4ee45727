"""Queries on levels over time: pauses, dips, onsets, blends, envelopes, offsets and gaps. Every window is of one track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, sequence
from ..sources.tables import table
from .base import SPANS, spans
from .catalog import query
from .spans import MERGED_B, SIDES, _edges

HOUR = 3_600_000
#: DuckDB: frames of a track, numbered in time order.
FRAMES = f"""{SPANS}, frames as (select track, id, label, start as t, value as level, row_number() over (partition by track order by start, id) - 1 as n from spans)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("track", "id", "label", F.col("start").alias("t"), F.col("value").alias("level"))
    return s.withColumn("n", (F.row_number().over(Window.partitionBy("track").orderBy("t", "id")) - 1).cast("bigint"))


def _time() -> Window:
    return Window.partitionBy("track").orderBy("n")


@query(f"""with {FRAMES}, q as (select *, level < 0.06 * max(level) over (partition by track) as quiet from frames), f as (select *, case when quiet = lag(quiet) over w then 0 else 1 end as fresh from q window w as (partition by track order by n)),
r as (select *, sum(fresh) over (partition by track order by n) as run, lead(t) over (partition by track order by n) as after from f)
select track, min(t) as start, max(after) as stop from r where quiet group by track, run having count(*) = count(after) and max(after) - min(t) >= {6 * HOUR}""")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs below 6 % of the track's peak of six hours or more; a run still open at the end is none."""
    q = _frames(spark, sf_dir).withColumn("quiet", F.col("level") < 0.06 * F.max("level").over(Window.partitionBy("track"))).withColumn("after", F.lead("t").over(_time()))
    runs = sequence.runs_of_equal(q, ["track"], ["n"], F.col("quiet"), "run").filter("quiet")
    out = runs.groupBy("track", "run").agg(F.min("t").alias("start"), F.max("after").alias("stop"), F.count_if(F.col("after").isNull()).alias("open"))
    return out.filter(f"open = 0 and stop - start >= {6 * HOUR}").select("track", "start", "stop")


@query(f"""with {FRAMES}, m as (select track, median(level) as middle from frames group by track), d as (select f.*, level < middle / 4 and lag(label) over (partition by track order by n) is distinct from label as dip from frames f join m using (track)),
g as (select *, case when dip = lag(dip) over w then 0 else 1 end as fresh from d window w as (partition by track order by n)), r as (select *, sum(fresh) over (partition by track order by n) as run from g)
select track, min(n) as first, max(n) as last, count(*) as frames, sum(count(*)) over (partition by track) ::bigint as total from r where dip group by track, run having count(*) >= 1""")
def dip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames 12 dB under the track's median while another label plays, and their sum."""
    f = _frames(spark, sf_dir)
    d = f.join(f.groupBy("track").agg(F.median("level").alias("middle")), "track")
    d = d.withColumn("dip", (F.col("level") < F.col("middle") / 4) & ~F.lag("label").over(_time()).eqNullSafe(F.col("label")))
    runs = sequence.runs_of_equal(d, ["track"], ["n"], F.col("dip"), "run").filter("dip")
    out = runs.groupBy("track", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("frames"))
    return out.withColumn("total", F.sum("frames").over(Window.partitionBy("track"))).drop("run")


@query(f"""with {FRAMES}, a as (select *, max(level) over (partition by track) as peak from frames), k as (select * from a where level >= 0.1 * peak), g as (select *, lead(t) over (partition by track order by n) - t as gap from k)
select track, max(t) as last_energy, max(t) filter (level >= 0.5 * peak) as held_end, max(t) filter (gap >= {24 * HOUR}) as before_gap, min(t) as first_sound from g group by track""")
def last_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last frame above a share of the peak, last one above half of it, the last before the rightmost long gap, and the first."""
    a = _frames(spark, sf_dir).withColumn("peak", F.max("level").over(Window.partitionBy("track"))).filter("level >= 0.1 * peak")
    g = a.withColumn("gap", F.lead("t").over(_time()) - F.col("t"))
    return g.groupBy("track").agg(F.max("t").alias("last_energy"), F.max(F.when(F.col("level") >= 0.5 * F.col("peak"), F.col("t"))).alias("held_end"), F.max(F.when(F.col("gap") >= 24 * HOUR, F.col("t"))).alias("before_gap"), F.min("t").alias("first_sound"))


@query(f"""with {FRAMES}, p as (select track, quantile_cont(level, 0.1) as floor, max(level) as peak, count(*) as members from frames group by track), a as (select f.*, members, level > floor + 0.1 * (peak - floor) as loud from frames f join p using (track)),
l as (select *, lead(loud, 1) over w as b, lead(loud, 2) over w as c from a window w as (partition by track order by n))
select track, case when any_value(members) >= 4 then coalesce(min(n) filter (loud and b and c), min(n) filter (loud)) end as onset from l group by track""")
def first_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of three frames in a row above the floor and a tenth of the way to the peak, else the first such frame; null under four frames."""
    f = _frames(spark, sf_dir)
    p = f.groupBy("track").agg(F.percentile("level", F.lit(0.1)).alias("floor"), F.max("level").alias("peak"), F.count(F.lit(1)).alias("members"))
    a = f.join(p, "track").withColumn("loud", F.col("level") > F.col("floor") + 0.1 * (F.col("peak") - F.col("floor")))
    l_ = a.withColumn("b", F.lead("loud", 1).over(_time())).withColumn("c", F.lead("loud", 2).over(_time()))
    first = F.coalesce(F.min(F.when(F.col("loud") & F.col("b") & F.col("c"), F.col("n"))), F.min(F.when(F.col("loud"), F.col("n"))))
    return l_.groupBy("track").agg(F.when(F.any_value("members") >= 4, first).alias("onset"))


@query(f"""with {FRAMES}, h as (select track, t, (t + lead(t) over (partition by track order by n)) // 2 as half from frames) select track, t as beat, false as between_beats from h union all select track, half, true from h where half is not null""")
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats and the half-way points between them."""
    h = _frames(spark, sf_dir).withColumn("half", F.floor((F.col("t") + F.lead("t").over(_time())) / 2))
    beats = h.select("track", F.col("t").alias("beat"), F.lit(False).alias("between_beats"))
    return beats.unionByName(h.filter("half is not null").select("track", F.col("half").alias("beat"), F.lit(True).alias("between_beats")))


@query(f"""with {FRAMES} select track, round(10 * log10(avg(level * level) filter (label = 'error') / avg(level * level) filter (label <> 'error')), 5) as contrast_db from frames group by track""")
def crowd_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power inside flagged frames against that of the others, in dB; null where one side is empty."""
    power = lambda c: F.avg(F.when(c, F.col("level") * F.col("level")))
    flagged = F.col("label") == "error"
    return _frames(spark, sf_dir).groupBy("track").agg(F.round(10 * F.log10(power(flagged) / power(~flagged)), 5).alias("contrast_db"))


BLEND = f"""{FRAMES}, w as (select label, greatest(length(label) - 4, 0) as weight from frames group by label), s as (select label, weight / sum(weight) over () as share from w),
p as (select track, n // 5 as place, label, avg(level) as level from frames group by all)"""


@query(f"""with {BLEND} select track, place, round(sum(level * share) / sum(share), 6) as mean, round(median(level), 6) as middle, round(min(level), 6) as least, round(max(level), 6) as most, count(*) as parts from p join s using (label) where share > 0 group by track, place""")
def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series put together by position: mean with normalised weights that are not negative, median, least and most."""
    f = _frames(spark, sf_dir)
    w = f.select("label").distinct().withColumn("weight", F.greatest(F.length("label") - 4, F.lit(0)))
    total = w.agg(F.sum("weight").alias("total"))  # one row
    s = w.join(F.broadcast(total)).withColumn("share", F.col("weight") / F.col("total")).filter("share > 0").select("label", "share")
    p = f.groupBy("track", F.floor(F.col("n") / 5).alias("place"), "label").agg(F.avg("level").alias("level")).join(F.broadcast(s), "label")
    mean = F.sum(F.col("level") * F.col("share")) / F.sum("share")
    return p.groupBy("track", "place").agg(F.round(mean, 6).alias("mean"), F.round(F.median("level"), 6).alias("middle"), F.round(F.min("level"), 6).alias("least"), F.round(F.max("level"), 6).alias("most"), F.count(F.lit(1)).alias("parts"))


@query(f"""with {BLEND}, b as (select track, place, avg(level) as blend, max(level) as loudest, max_by(label, (level, label)) as source from p group by track, place)
select track, place, source, round(case when blend < loudest / 2 then loudest else blend end, 6) as level, blend < loudest / 2 as repaired from b""")
def repaired_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blend falls 6 dB under its loudest part, that part stands in."""
    # a place has five frames at most, so sixty times a label's mean is a whole multiple of its sum: decimals decide where doubles are too near to tell
    whole, n = F.col("level").try_cast("decimal(18,9)"), F.count("level")
    exact = F.when(F.count(whole) == n, F.sum(whole) * F.try_divide(F.lit(60), n).cast("decimal(2,0)"))
    p = _frames(spark, sf_dir).groupBy("track", F.floor(F.col("n") / 5).alias("place"), "label").agg(F.avg("level").alias("level"), exact.alias("exact"))
    b = p.groupBy("track", "place").agg(
        F.avg("level").alias("blend"), F.max("level").alias("loudest"), F.max_by("label", F.struct("level", "label")).alias("source"),
        F.sum(F.col("exact") * F.lit(2).cast("decimal(1,0)")).alias("twice"), F.when(F.count("exact") == n, F.max("exact") * n.cast("decimal(1,0)")).alias("most"),
    )
    near = F.abs(F.col("blend") - F.col("loudest") / 2) <= 1e-9 * F.abs("loudest")
    dip = F.coalesce(F.when(near, F.col("twice") < F.col("most")), F.col("blend") < F.col("loudest") / 2)
    return b.select("track", "place", "source", F.round(F.when(dip, F.col("loudest")).otherwise(F.col("blend")), 6).alias("level"), dip.alias("repaired"))


@query(f"""with {FRAMES}, k as (select track, n // 4 as place, level, n from frames) select track, place, round(avg(level), 6) as pooled, count(*) as frames from k group by track, place""")
def pooled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames pooled by four."""
    return _frames(spark, sf_dir).groupBy("track", F.floor(F.col("n") / 4).alias("place")).agg(F.round(F.avg("level"), 6).alias("pooled"), F.count(F.lit(1)).alias("frames"))


@query(f"""with {FRAMES} select track, n, round((coalesce(lag(level, 2) over w, 0) + 2 * coalesce(lag(level, 1) over w, 0) + 3 * level + 2 * coalesce(lead(level, 1) over w, 0) + coalesce(lead(level, 2) over w, 0)) / 9, 6) as level from frames window w as (partition by track order by n)""")
def five_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels smoothed by the kernel 1, 2, 3, 2, 1; beyond the ends there is silence."""
    near = lambda k: F.coalesce((F.lag if k < 0 else F.lead)("level", abs(k)).over(_time()), F.lit(0.0))
    return _frames(spark, sf_dir).select("track", "n", F.round((near(-2) + 2 * near(-1) + 3 * F.col("level") + 2 * near(1) + near(2)) / 9, 6).alias("level"))


@query(f"""with {FRAMES}, l as (select *, lag(level) over w as a, lead(level) over w as b from frames window w as (partition by track order by n))
select track, n, round(n + case when a is null or b is null or a - 2 * level + b = 0 then 0 else greatest(-0.5, least(0.5, 0.5 * (a - b) / (a - 2 * level + b))) end, 6) as peak from l where level >= coalesce(a, level) and level >= coalesce(b, level)""")
def parabolic_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima refined by a parabola through their neighbours, by half a frame at most."""
    l_ = _frames(spark, sf_dir).withColumn("a", F.lag("level").over(_time())).withColumn("b", F.lead("level").over(_time()))
    l_ = l_.filter((F.col("level") >= F.coalesce("a", "level")) & (F.col("level") >= F.coalesce("b", "level")))
    bend = F.col("a") - 2 * F.col("level") + F.col("b")
    shift = F.when(F.col("a").isNull() | F.col("b").isNull() | (bend == 0), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("a") - F.col("b")) / F.nullif(bend, F.lit(0.0)))))
    return l_.select("track", "n", F.round(F.col("n") + shift, 6).alias("peak"))


@query(f"""with {FRAMES} select track, max_by(value, (confidence, id)) as displacement, max(stop) as until, count(*) as regions from spans group by track""")
def collapsed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions of a track replaced by the most confident one's offset over the whole span."""
    return spans(spark, sf_dir).groupBy("track").agg(F.max_by("value", F.struct("confidence", "id")).alias("displacement"), F.max("stop").alias("until"), F.count(F.lit(1)).alias("regions"))


@query(f"""with {SIDES}, {MERGED_B}, g as (select track, stop as low, lead(start) over (partition by track order by start) as high from mb)
select track, low, high, high - low as gap from g where high - low >= {HOUR} qualify row_number() over (partition by track order by high - low desc, low) = 1""")
def largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest silence of an hour or more between the merged spans of each track."""
    _, b = _edges(spark, sf_dir)
    m = intervals.merged(b, ["track"]).withColumn("high", F.lead("start").over(Window.partitionBy("track").orderBy("start"))).select("track", F.col("stop").alias("low"), "high")
    g = m.withColumn("gap", F.col("high") - F.col("low")).filter(F.col("gap") >= HOUR)
    return sequence.newest(g, ["track"], [F.desc("gap"), F.asc("low")], 1)


@query(f"""with {SIDES}, {MERGED_B}, f as (select a.track, a.id, a.start, max(mb.stop) filter (mb.start <= a.start) as low, min(mb.start) filter (mb.start > a.start) as high, max(mb.start) filter (mb.start <= a.start) as own from a left join mb on a.track = mb.track group by all)
select track, id, start, case when low > start then low else start end as moved, low is not null and low > start as blocked, high as limit_at from f""")
def clamped_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts inside a blocked stretch move to its end; the next blocked stretch limits them. One sweep in time order, no pairs."""
    a, b = _edges(spark, sf_dir)
    m = intervals.merged(b, ["track"]).select("track", "start", "stop", F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("side"))
    both = m.unionByName(a.select("track", "start", F.lit(None).cast("bigint").alias("stop"), "id", F.lit(1).alias("side")))
    w = Window.partitionBy("track").orderBy("start", "side", "id")
    low = F.last("stop", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = Window.partitionBy("track").orderBy(F.col("start").desc(), F.col("side").desc(), F.col("id").desc())
    high = F.last(F.when(F.col("side") == 0, F.col("start")), True).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("low", low).withColumn("limit_at", high).filter("side = 1")
    blocked = F.coalesce(F.col("low") > F.col("start"), F.lit(False))
    return out.select("track", "id", "start", F.when(blocked, F.col("low")).otherwise(F.col("start")).alias("moved"), blocked.alias("blocked"), "limit_at")


@query(f"""with {FRAMES}, i as (select track, id, start, stop from spans where label = 'error'), g as (select f.track, f.n, f.t, f.level, least(1.0, min(case when f.t < i.start - {HOUR} or f.t > i.stop + {HOUR} then 1.0 when f.t < i.start then 0.2 + 0.8 * (i.start - f.t) / {HOUR} when f.t > i.stop then 0.2 + 0.8 * (f.t - i.stop) / {HOUR} else 0.2 end)) as gain
from frames f left join i on f.track = i.track group by all) select track, n, round(coalesce(gain, 1.0), 6) as gain, round(level * coalesce(gain, 1.0), 6) as level from g""")
def damped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels under an envelope that fades to a fifth around flagged spans, the smallest gain where spans overlap.

    The gain at a frame depends on its distance to the nearest flagged span; the running ends and starts of a
    sweep in time order give that distance on both sides.
    """
    f = _frames(spark, sf_dir).select("track", "n", "t", "level", F.lit(None).cast("bigint").alias("stop"), F.lit(1).alias("side"))
    i = spans(spark, sf_dir).filter("label = 'error'").select("track", F.lit(None).cast("bigint").alias("n"), F.col("start").alias("t"), F.lit(None).cast("double").alias("level"), "stop", F.lit(0).alias("side"))
    both = f.unionByName(i)
    before = F.max("stop").over(Window.partitionBy("track").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("side") == 0, F.col("t"))).over(Window.partitionBy("track").orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("ended", before).withColumn("begins", after).filter("side = 1")
    ramp = lambda gap: F.when(gap.isNull() | (gap > HOUR), 1.0).otherwise(0.2 + 0.8 * F.greatest(gap, F.lit(0)) / HOUR)
    gain = F.least(ramp(F.col("t") - F.col("ended")), ramp(F.col("begins") - F.col("t")))
    return out.select("track", "n", F.round(gain, 6).alias("gain"), F.round(F.col("level") * gain, 6).alias("level"))


@query(f"""with {SPANS}, w as (select track, start, stop, row_number() over (partition by track order by start, id) as n from spans), r as (select *, sum(stop - start) over (partition by track order by n desc) as upto from w)
select track, n, cast(case when upto > {HOUR} * 24 then stop - ({HOUR} * 24 - (upto - (stop - start))) else start end as bigint) as start, stop from r where upto - (stop - start) < {HOUR} * 24""")
def fitted_from_the_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 hours of a track's spans, the first kept one clipped."""
    w = spans(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("start", "id")).cast("bigint"))
    length, room = F.col("stop") - F.col("start"), F.lit(24 * HOUR)
    r = w.withColumn("upto", F.sum(length).over(Window.partitionBy("track").orderBy(F.desc("n")))).filter(F.col("upto") - length < room)
    return r.select("track", "n", F.when(F.col("upto") > room, F.col("stop") - (room - (F.col("upto") - length))).otherwise(F.col("start")).alias("start"), "stop")


@query(f"""with {SPANS}, o as (select *, row_number() over (partition by track order by start, id) as n, max(stop) over (partition by track order by start, id rows between unbounded preceding and 1 preceding) as ended from spans),
l as (select track, max(start) filter (label = 'view') as last from spans group by track)
select o.track, count(*) filter (start - coalesce(ended, 0) >= {5 * HOUR}) as gaps, cast(sum(case when label <> 'view' then greatest(0, stop - greatest(start, coalesce(last, 0))) else 0 end) as bigint) as after_the_text from o join l on o.track = l.track group by o.track""")
def gaps_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of five hours without a span, and the time of other spans after the last line's start."""
    s = spans(spark, sf_dir)
    ended = F.max("stop").over(Window.partitionBy("track").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1))
    o = s.withColumn("ended", F.coalesce(ended, F.lit(0))).join(s.groupBy("track").agg(F.coalesce(F.max(F.when(F.col("label") == "view", F.col("start"))), F.lit(0)).alias("last")), "track")
    tail = F.when(F.col("label") != "view", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "last"))).otherwise(0)
    return o.groupBy("track").agg(F.count_if(F.col("start") - F.col("ended") >= 5 * HOUR).alias("gaps"), F.sum(tail).alias("after_the_text"))


@query(f"""with {FRAMES}, x as (select vec_id, unnest(list_transform(embedding, lambda y: cast(y as double))) as v, generate_subscripts(embedding, 1) as i from embeddings), p as (select vec_id, max(abs(v)) as peak from x group by vec_id)
select x.vec_id, min(i) filter (abs(v) > 0.5 * peak) - 1 as leading, count(*) filter (abs(v) > 0.5 * peak) as loud, 64.0 / 16000 as seconds, cast(round_even(peak * 16000, 0) as bigint) as samples from x join p using (vec_id) group by x.vec_id, peak""")
def leading_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples before the first loud one, loud ones, length, and a time in samples, of each vector as a signal."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").withColumn("peak", F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))
    loud = F.transform("embedding", lambda x: F.abs(x.cast("double")) > 0.5 * F.col("peak"))
    return e.select("vec_id", F.array_position(loud, True).alias("p"), F.size(F.filter(loud, lambda x: x)).cast("bigint").alias("loud"), "peak").select("vec_id", F.when(F.col("p") > 0, F.col("p") - 1).cast("bigint").alias("leading"), "loud", F.lit(64.0 / 16000).alias("seconds"), F.bround(F.col("peak") * 16000).cast("bigint").alias("samples"))
