"""Queries on timed spans: merging, grouping, coverage, nearest joins, fills and robust figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, nearest, sequence, stats
from ..sources.tables import table
from .base import SPANS, spans
from .catalog import query

HOUR = 3_600_000
#: Two sides of one event stream: what is "sung" and what is "heard".
ACTIVE = ("view", "click")


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = spans(spark, sf_dir)
    return s.filter(F.col("label").isin(*ACTIVE)), s.filter(~F.col("label").isin(*ACTIVE))


SIDES = f"""{SPANS}, a as (select * from spans where label in ('view', 'click')), b as (select * from spans where label not in ('view', 'click'))"""
#: DuckDB: union of the spans of b.
MERGED_B = """mb0 as (select track, start, stop, case when start > coalesce(max(stop) over (partition by track order by start, stop rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from b),
mb1 as (select *, sum(fresh) over (partition by track order by start, stop rows between unbounded preceding and current row) as part from mb0),
mb as (select track, min(start) as start, max(stop) as stop from mb1 group by track, part)"""


@query(f"""with {SPANS}, f as (select *, case when start > coalesce(max(stop) over (partition by track order by start, stop rows between unbounded preceding and 1 preceding) + {HOUR}, -1) then 1 else 0 end as fresh from spans),
p as (select *, sum(fresh) over (partition by track order by start, stop rows between unbounded preceding and current row) as part from f)
select track, min(start) as start, max(stop) as stop, count(*) as members, array_to_string(list_sort(list_distinct(list(label))), '+') as labels, min(value) as strongest from p group by track, part""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans merged across gaps of up to an hour, with their labels and the smallest value."""
    return intervals.merged(spans(spark, sf_dir), ["track"], HOUR, [F.array_join(F.array_sort(F.collect_set("label")), "+").alias("labels"), F.min("value").alias("strongest")])


@query(f"""with {SPANS}, f as (select *, case when start - lag(stop) over w <= {6 * HOUR} then 0 else 1 end as fresh from spans window w as (partition by track order by start, id)),
p as (select *, sum(fresh) over (partition by track order by start, id) as part from f)
select track, part, min(start) as start, arg_max(stop, (start, id)) as stop, count(*) as words, string_agg(label, ' ' order by start, id) as text from p group by track, part""")
def segments_by_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans regrouped where the pause after the previous one is above six hours."""
    p = intervals.grouped_by_pause(spans(spark, sf_dir), ["track"], 6 * HOUR, ["start", "id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "id", "label"))), lambda x: x["label"]), " ")
    return p.groupBy("track", "part").agg(F.min("start").alias("start"), F.max_by("stop", F.struct("start", "id")).alias("stop"), F.count(F.lit(1)).alias("words"), text.alias("text"))


@query(f"""with {SIDES}, {MERGED_B} select a.track, a.start, a.stop, cast(sum(case when mb.start < a.stop and mb.stop > a.start then least(mb.stop, a.stop) - greatest(mb.start, a.start) else 0 end) as bigint) as covered,
a.stop - a.start - covered as uncovered from (select distinct track, start, stop from a) a left join mb on a.track = mb.track group by a.track, a.start, a.stop""")
def covered_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per active span, the time that the union of the other spans covers, and the rest."""
    a, b = _edges(spark, sf_dir)
    return intervals.covered(a.select("track", "start", "stop").distinct(), b, ["track"])


@query(f"""with {SIDES}, e as (select track, start as t, 1 as da, 0 as db from a union all select track, stop, -1, 0 from a union all select track, start, 0, 1 from b union all select track, stop, 0, -1 from b),
g as (select track, t, sum(da) as da, sum(db) as db from e group by track, t),
s as (select track, t as start, lead(t) over (partition by track order by t) as stop, sum(da) over (partition by track order by t) as na, sum(db) over (partition by track order by t) as nb from g),
o as (select * from s where stop is not null and na > 0 and nb <= 0), f as (select *, case when start > coalesce(lag(stop) over (partition by track order by start), -1) then 1 else 0 end as fresh from o),
p as (select *, sum(fresh) over (partition by track order by start) as part from f)
select track, min(start) as start, max(stop) as stop from p group by track, part having max(stop) - min(start) >= 600000""")
def only_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least ten minutes that active spans cover and no other span does."""
    a, b = _edges(spark, sf_dir)
    return intervals.only_in(a, b, ["track"], 600_000)


@query(f"with {SIDES} select id, track, label from a where exists (select 1 from b where a.track = b.track and a.start < b.stop - 1000 and a.stop > b.start + 1000)")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active spans that overlap another span by more than a second."""
    a, b = _edges(spark, sf_dir)
    return intervals.overlapping(a, b, ["track"], 1000).select("id", "track", "label")


@query(f"with {SIDES} select id, track, label from a where not exists (select 1 from b where a.track = b.track and a.start < b.stop and a.stop > b.start)")
def spans_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active spans that no other span overlaps."""
    a, b = _edges(spark, sf_dir)
    return intervals.overlapping(a, b, ["track"], 0, "left_anti").select("id", "track", "label")


@query(f"""with {SPANS}, x as (select track, id, stop, unnest(range(start, greatest(start, stop - 1) + 1, 800000)) as piece_start from spans)
select track, id, piece_start, least(piece_start + 1200000, stop) as piece_stop from x""")
def overlapping_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span cut into pieces of 20 minutes that overlap by 400 seconds."""
    return intervals.pieces(spans(spark, sf_dir), ["track", "id"], 1_200_000, 400_000)


@query(f"""with {SPANS}, p as (select *, value >= 0.08 * max(value) over (partition by track) as loud, coalesce(lead(start) over w, start) as nxt from spans window w as (partition by track order by start)),
f as (select *, case when loud is distinct from lag(loud) over w then 1 else 0 end as fresh from p window w as (partition by track order by start)),
r as (select *, sum(fresh) over (partition by track order by start) as run from f), u as (select track, min(start) as start, max(nxt) as stop from r where loud group by track, run),
g as (select *, case when start - lag(stop) over (partition by track order by start) < {HOUR} then 0 else 1 end as fresh from u), h as (select *, sum(fresh) over (partition by track order by start) as part from g)
select track, min(start) as start, max(stop) as stop from h group by track, part having max(stop) - min(start) >= {HOUR}""")
def active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches above 8 % of the track's peak; gaps under an hour are bridged, stretches under an hour go."""
    frames = spans(spark, sf_dir).select("track", F.col("start").alias("at"), F.col("value").alias("level"))
    return intervals.active_windows(frames, ["track"], 0.08, HOUR, HOUR)


@query(f"""with {SIDES}, m as (select distinct track, start as m from b), n as (select a.track, a.id, a.start, m.m, abs(a.start - m.m) as d from a left join m on a.track = m.track)
select track, id, start, arg_min(m, (d, m)) as nearest, min(d) as distance from n group by track, id, start""")
def nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each active start, the nearest start of another span; the earlier on ties."""
    a, b = _edges(spark, sf_dir)
    return nearest.nearest(a.select("track", "id", "start"), b.select("track", F.col("start").alias("at")), ["track"], "start", "id")


@query(f"""with {SIDES}, m as (select distinct track, start as m from b), n as (select a.track, a.id, min(abs(a.start - m.m)) as d from a join m on a.track = m.track group by all)
select track, median(d) as distance, count(*) as starts, round(100.0 * count(*) filter (d <= {HOUR}) / count(*), 1) as hits from n group by track""")
def start_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track, the median distance to the nearest mark and the percentage within an hour."""
    a, b = _edges(spark, sf_dir)
    n = nearest.nearest(a.select("track", "id", "start"), b.select("track", F.col("start").alias("at")), ["track"], "start", "id").filter("nearest is not null")
    return n.groupBy("track").agg(F.median("distance").alias("distance"), F.count(F.lit(1)).alias("starts"), F.round(100.0 * F.count_if(F.col("distance") <= HOUR) / F.count(F.lit(1)), 1).alias("hits"))


@query(f"""with {SPANS}, z as (select track, min(start) as zero from spans group by track), r as (select s.track, (s.start + s.stop) / 2.0 - z.zero as c, s.value as o from spans s join z using (track) where label = 'error'),
q as (select s.track, s.id, cast(s.start - z.zero as double) as t from spans s join z using (track) where label = 'view'),
j as (select q.*, (select arg_max(o, (c, o)) from r where r.track = q.track and r.c <= q.t) as o0, (select max(c) from r where r.track = q.track and r.c <= q.t) as c0,
(select arg_min(o, (c, o)) from r where r.track = q.track and r.c >= q.t) as o1, (select min(c) from r where r.track = q.track and r.c >= q.t) as c1 from q)
select track, id, round(greatest(0, t + case when c0 is null then coalesce(o1, 0) when c1 is null then o0 when c0 = c1 then o0 else o0 + (t - c0) / (c1 - c0) * (o1 - o0) end), 3) as projected from j""")
def projected_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View times moved by offsets interpolated between the centres of error spans."""
    s = spans(spark, sf_dir)
    s = s.withColumn("zero", F.min("start").over(Window.partitionBy("track")))
    s = s.withColumn("start", F.col("start") - F.col("zero")).withColumn("stop", F.col("stop") - F.col("zero"))
    regions = s.filter("label = 'error'").select("track", "start", "stop", F.col("value").alias("offset"))
    out = nearest.projected(s.filter("label = 'view'").select("track", "id", "start"), regions, ["track"], "start", "id")
    return out.select("track", "id", F.round("projected", 3).alias("projected"))


GAPPED = f"""{SPANS}, g as (select track, id, row_number() over (partition by track order by start, id) as pos, case when label in ('view', 'error') then start / 1000.0 end as start, case when label in ('view', 'error') then stop / 1000.0 end as stop from spans)"""


@query(f"""with {GAPPED}, u as (select track, greatest(0.3, coalesce(list_sort(list(stop - start) filter (stop > start))[cast(floor(count(*) filter (stop > start) / 2) as int) + 1], 2.0)) as usual from g group by track),
l as (select g.*, last_value(stop ignore nulls) over (partition by track order by pos) as l, first_value(start ignore nulls) over (partition by track order by pos rows between current row and unbounded following) as r,
case when start is not null or lag(start) over (partition by track order by pos) is not null or pos = 1 then 1 else 0 end as fresh from g),
p as (select *, sum(fresh) over (partition by track order by pos) as run from l), n as (select p.*, usual, count(*) over (partition by p.track, run) as n, row_number() over (partition by p.track, run order by pos) - 1 as k from p join u using (track))
select track, id, cast(floor(1000 * case when start is not null then start else greatest(0.0, case when l is null then r - (n - k) * usual when r is null then l + k * usual else l + k * ((r - l) / n) end) end + 0.5) as bigint) as start,
cast(floor(1000 * case when start is not null then stop else greatest(0.0, case when l is null then r - (n - k) * usual + usual when r is null then l + k * usual + usual else l + k * ((r - l) / n) + (r - l) / n end) end + 0.5) as bigint) as stop from n""")
def interpolated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without times get them from their known neighbours."""
    s = spans(spark, sf_dir)
    known = F.col("label").isin("view", "error")
    g = s.withColumn("pos", F.row_number().over(Window.partitionBy("track").orderBy("start", "id")))
    g = g.select("track", "id", "pos", F.when(known, F.col("start") / 1000.0).alias("start"), F.when(known, F.col("stop") / 1000.0).alias("stop"))
    return sequence.interpolated(g, ["track"], "pos").select("track", "id", *(F.floor(1000 * F.col(c) + 0.5).alias(c) for c in ("start", "stop")))


@query(f"""with {SPANS}, d as (select track, label, stop - start as d from spans), m as (select track, label, count(*) as n, median(d) as median from d group by all having count(*) >= 3),
s as (select d.track, d.label, any_value(n) as n, any_value(median) as median, median(abs(d - median)) as mad from d join m on d.track = m.track and d.label = m.label group by all)
select * from s where median > 0.05 and mad / median <= 0.6""")
def reference_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual length per track and label, where at least three agree."""
    d = spans(spark, sf_dir).select("track", "label", (F.col("stop") - F.col("start")).alias("d"))
    return stats.reference_values(d, ["track", "label"], "d", 3, 0.6)


@query(f"""with {SPANS}, i as (select track, lead(start) over (partition by track order by start, id) - start as i from spans), u as (select track, i from i where i > 1200000 and i < 70000000),
m as (select track, median(i) as period, count(*) as n from u group by track having count(*) >= 5), s as (select u.track, any_value(period) as period, median(abs(i - period)) / any_value(period) as spread from u join m on u.track = m.track group by u.track)
select track, period, round(spread, 9) as spread from s where spread <= 0.7""")
def phrase_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median interval between starts of a track, null tracks and erratic ones left out."""
    step = F.lead("start").over(Window.partitionBy("track").orderBy("start", "id")) - F.col("start")
    usable = spans(spark, sf_dir).select("track", step.alias("i")).filter("i > 1200000 and i < 70000000")
    out = stats.median_and_spread(usable, ["track"], "i", 5).withColumn("spread", F.col("mad") / F.col("median"))
    return out.filter("spread <= 0.7").select("track", F.col("median").alias("period"), F.round("spread", 9).alias("spread"))


@query(f"""with {SPANS} select track, label, list_sort(list(stop - start))[count(*) // 2 + 1] as upper_median, median(stop - start) as median, max(start) - min(start) as drift from spans group by track, label""")
def two_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and interpolating median of the lengths, and the drift of the starts."""
    d = F.col("stop") - F.col("start")
    return spans(spark, sf_dir).groupBy("track", "label").agg(stats.upper_median(d).alias("upper_median"), F.median(d).alias("median"), (F.max("start") - F.min("start")).alias("drift"))


@query(f"""with {SPANS}, l as (select *, lag(start) over w as ps, lag(stop) over w as pe from spans window w as (partition by track order by id))
select track, count(*) as rows_, count(*) filter (start < ps) as out_of_order, count(*) filter (start = ps) as stacked, count(*) filter (start < pe) as overlapping, count(*) filter (stop - start < 60000) as too_short, count(*) filter (stop <= start) as empty from l group by track""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of what is wrong with a track's spans in their order."""
    w = Window.partitionBy("track").orderBy("id")
    c = spans(spark, sf_dir).withColumn("ps", F.lag("start").over(w)).withColumn("pe", F.lag("stop").over(w))
    return c.groupBy("track").agg(F.count(F.lit(1)).alias("rows_"), F.count_if(F.col("start") < F.col("ps")).alias("out_of_order"), F.count_if(F.col("start") == F.col("ps")).alias("stacked"), F.count_if(F.col("start") < F.col("pe")).alias("overlapping"), F.count_if(F.col("stop") - F.col("start") < 60_000).alias("too_short"), F.count_if(F.col("stop") <= F.col("start")).alias("empty"))


@query(f"""with {SPANS}, m as (select track, label, median(stop - start) as usual from spans group by all)
select track, count(*) as spans, count(*) filter (stop - start > 2 * usual or stop - start < usual / 2) as outliers from spans join m using (track, label) group by track""")
def duration_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans more than a factor two away from their label's median."""
    s = spans(spark, sf_dir).withColumn("d", F.col("stop") - F.col("start"))
    m = s.groupBy("track", "label").agg(F.median("d").alias("usual"))
    return s.join(m, ["track", "label"]).groupBy("track").agg(F.count(F.lit(1)).alias("spans"), F.count_if((F.col("d") > 2 * F.col("usual")) | (F.col("d") < F.col("usual") / 2)).alias("outliers"))


@query(f"""with {SPANS} select track, label, start, value, row_number() over (partition by track order by value * confidence desc, id) as place from spans qualify place <= 3""")
def best_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three anchors of largest effect in each track; the first wins ties."""
    w = Window.partitionBy("track").orderBy(F.desc(F.col("value") * F.col("confidence")), "id")
    return spans(spark, sf_dir).select("track", "label", "start", "value", "id", "confidence", F.row_number().over(w).alias("place")).filter("place <= 3").drop("id", "confidence")


@query(f"""with {SPANS}, l as (select track, id, label, start, lead(start) over (partition by track order by start, id) as ns, stop from spans)
select track, id, start, case when ns is not null and stop > ns then greatest(ns, start) else stop end as stop from l""")
def repaired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops cut back to the next start; starts stay."""
    nxt = F.lead("start").over(Window.partitionBy("track").orderBy("start", "id"))
    s = spans(spark, sf_dir).withColumn("ns", nxt)
    return s.select("track", "id", "start", F.when(F.col("ns").isNotNull() & (F.col("stop") > F.col("ns")), F.greatest("ns", "start")).otherwise(F.col("stop")).alias("stop"))


@query(f"""with recursive {SPANS}, o as (select track, start, stop, row_number() over (partition by track order by start, stop) as n from spans),
k(track, n, start, stop, last) as (select track, n, start, stop, stop from o where n = 1 union all select o.track, o.n, o.start, o.stop, case when o.start >= k.last then o.stop else k.last end from o join k on o.track = k.track and o.n = k.n + 1),
m as (select track, start, stop, n, last, lag(last) over (partition by track order by n) as before from k) select track, start, stop from m where n = 1 or start >= before""")
def greedy_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans kept in order of start where each begins after the last KEPT one has ended."""
    items = F.array_sort(F.collect_list(F.struct("start", "stop")))
    kept = spans(spark, sf_dir).groupBy("track").agg(items.alias("items")).select("track", F.explode(sequence.non_overlapping(F.col("items"))).alias("x"))
    return kept.select("track", "x.start", "x.stop")


@query(f"""with recursive {SPANS}, o as (select track, start / 1000.0 as start, stop / 1000.0 as stop, row_number() over (partition by track order by id) as n from spans),
k(track, n, start, stop) as (select track, n, start, greatest(stop, start + 60) from o where n = 1 union all select o.track, o.n, greatest(o.start, k.stop), greatest(o.stop, greatest(o.start, k.stop) + 60) from o join k on o.track = k.track and o.n = k.n + 1)
select track, cast(n as bigint) as n, round(start, 3) as start, round(stop, 3) as stop from k""")
def monotonic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans pushed so that none begins before the one before it ends, each a minute at least."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", (F.col("start") / 1000.0).alias("start"), (F.col("stop") / 1000.0).alias("stop")))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    out = spans(spark, sf_dir).groupBy("track").agg(items.alias("items")).select("track", F.posexplode(sequence.monotonic(F.col("items"), 60.0)).alias("n", "x"))
    return out.select("track", (F.col("n") + 1).cast("bigint").alias("n"), F.round("x.start", 3).alias("start"), F.round("x.stop", 3).alias("stop"))


@query()
def spread_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest starts of each track that are at least a day apart."""
    items = F.collect_list(F.struct(F.col("value").alias("level"), F.col("start").alias("at")))
    return spans(spark, sf_dir).groupBy("track").agg(items.alias("items")).select("track", F.explode(sequence.spread_picks(F.col("items"), 24 * HOUR)).alias("at"))


@query(f"""with {SPANS} select track, label, id from spans qualify row_number() over (partition by track, label order by start desc, id desc) <= 3""")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of each key."""
    return sequence.newest(spans(spark, sf_dir), ["track", "label"], [F.desc("start"), F.desc("id")], 3).select("track", "label", "id")


@query(f"""with {SPANS}, p as (select *, row_number() over (partition by track order by start, id) - row_number() over (partition by track, label order by start, id) as run from spans)
select track, label, min(start) as start, max(stop) as stop, count(*) as n from p group by track, label, run having count(*) >= 3""")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more spans of one label in a row."""
    r = sequence.runs_of_equal(spans(spark, sf_dir), ["track"], ["start", "id"], F.col("label"))
    return r.groupBy("track", "label", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("part")


@query(f"""with {SPANS}, w as (select track, start, unnest([start // 10800000 * 10800000, start // 10800000 * 10800000 - 5400000 + case when start % 10800000 >= 5400000 then 10800000 else 0 end]) as frame, value from spans)
select track, frame, count(*) as n, round(sqrt(avg(value * value)), 6) as rms from w group by track, frame""")
def sliding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of the values in three-hour windows that slide by one and a half."""
    size, half = 3 * HOUR, 3 * HOUR // 2
    base = F.col("start") - F.col("start") % size
    other = base - half + F.when(F.col("start") % size >= half, size).otherwise(0)
    w = spans(spark, sf_dir).select("track", "value", F.explode(F.array(base, other)).alias("frame"))
    return w.groupBy("track", "frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


@query(f"""with {SPANS}, v as (select track, start // 86400000 as day, max(value) as peak from spans group by all) select track, day, round(peak / max(peak) over (partition by track), 9) as peak from v""")
def scaled_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily peaks as a share of the track's peak."""
    v = spans(spark, sf_dir).groupBy("track", F.floor(F.col("start") / 86_400_000).alias("day")).agg(F.max("value").alias("peak"))
    return v.select("track", "day", F.round(F.col("peak") / F.max("peak").over(Window.partitionBy("track")), 9).alias("peak"))


@query(f"""with {SPANS}, c as (select track, count(distinct label) as kinds, list_sort(list_distinct(list(label))) as every from spans group by track) select track, array_to_string(every, ',') as labels, kinds,
substring(sha1(track || '|' || array_to_string(every, ',')), 1, 12) as fingerprint from c""")
def track_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent fingerprint of what a track holds."""
    c = spans(spark, sf_dir).groupBy("track").agg(F.count_distinct("label").alias("kinds"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return c.select("track", "labels", "kinds", F.substring(F.sha1(F.concat_ws("|", F.col("track").cast("string"), "labels").cast("binary")), 1, 12).alias("fingerprint"))


@query("""with e as (select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type, value from events) select event_type, k, count(*) as n, max(value) as best, arg_max(event_id, (value, -event_id)) as winner from e group by all""")
def settings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed settings parsed from JSON, with the best row of each."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.from_json("props", "k BIGINT")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("winner"))
