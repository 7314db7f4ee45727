"""Queries for the smaller operators: filters, marks, neighbours, trials and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grams
from ..sources.tables import table
from .base import NORM, SPANS, WORDS, spans, words
from .catalog import query


def _in_track():
    return Window.partitionBy("track").orderBy("start", "id")


@query(f"""with {SPANS} select track, id from spans where not (stop - start <= 50000 and confidence <= 0.01)""")
def without_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows but for those that are short AND uncertain."""
    return spans(spark, sf_dir).filter(~((F.col("stop") - F.col("start") <= 50_000) & (F.col("confidence") <= 0.01))).select("track", "id")


@query(f"""with {SPANS}, n as (select *, row_number() over (partition by track order by start, id) as pos from spans), t as (select track, max(pos) filter (value >= 60) as good from n group by track)
select n.track, n.id, case when good is not null and pos > good then null else label end as label from n join t using (track)""")
def trimmed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplings after the last good one are nulled; a track without a good one stays."""
    n = spans(spark, sf_dir).withColumn("pos", F.row_number().over(_in_track()))
    good = F.max(F.when(F.col("value") >= 60, F.col("pos"))).over(Window.partitionBy("track"))
    return n.withColumn("good", good).select("track", "id", F.when(~F.coalesce(F.col("pos") > F.col("good"), F.lit(False)), F.col("label")).alias("label"))


@query(f"""with {SPANS}, d as (select track, label, list(distinct id % 5) as has from spans group by all) select track, label, len(list_filter([0, 1, 2, 3, 4], lambda x: not list_contains(has, x))) = 0 as accepted from d""")
def capable_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a worker has covers what is needed."""
    d = spans(spark, sf_dir).groupBy("track", "label").agg(F.collect_set(F.col("id") % 5).alias("has"))
    return d.select("track", "label", (F.size(F.array_except(F.array(*(F.lit(x).cast("bigint") for x in range(5))), "has")) == 0).alias("accepted"))


@query("""with c as (select o_custkey as song, o_orderpriority as text, o_totalprice as error, count(*) over (partition by o_custkey, o_orderpriority) as n from orders)
select song, count(*) filter (n = 1) as unique_lines, count(*) filter (n > 1) as repeated_lines, min(error) filter (n = 1) as unique_least, max(error) filter (n > 1) as repeated_most from c group by song""")
def unique_against_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose text occurs once against those that are repeated."""
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority"))
    c = table(spark, sf_dir, "orders").withColumn("n", n)
    once, more = F.col("n") == 1, F.col("n") > 1
    return c.groupBy(F.col("o_custkey").alias("song")).agg(F.count_if(once).alias("unique_lines"), F.count_if(more).alias("repeated_lines"), F.min(F.when(once, F.col("o_totalprice"))).alias("unique_least"), F.max(F.when(more, F.col("o_totalprice"))).alias("repeated_most"))


@query("""with s as (select o_custkey as song, o_orderstatus as variant, count(*) as n from orders group by all), k as (select song from s group by song having count(distinct variant) = (select count(distinct variant) from s))
select variant, count(*) as songs, sum(n)::bigint as lines from s join k using (song) group by variant""")
def common_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures over the songs that every variant measured."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("song"), F.col("o_orderstatus").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    variants = s.agg(F.count_distinct("variant").alias("every"))
    full = s.groupBy("song").agg(F.count_distinct("variant").alias("own")).join(F.broadcast(variants), F.col("own") == F.col("every")).select("song")
    return s.join(full, "song").groupBy("variant").agg(F.count(F.lit(1)).alias("songs"), F.sum("n").alias("lines"))


@query(f"""with {SPANS}, p as (select track, id // 3 as target, min(start) as pin_start, max(stop) as pin_stop, string_agg(label, ' ' order by id) as pin_text from spans where label = 'error' group by all)
select s.track, s.id, coalesce(pin_start, start) as start, coalesce(pin_stop, stop) as stop, coalesce(pin_text, label) as text, case when pin_start is not null then 1.0 else confidence end as confidence from spans s left join p on s.track = p.track and s.id = p.target""")
def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides replace a coupling: least start, largest stop, joined text, certainty 1."""
    s = spans(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]), " ")
    pins = s.filter("label = 'error'").groupBy("track", F.floor(F.col("id") / 3).alias("id")).agg(F.min("start").alias("ps"), F.max("stop").alias("pe"), joined.alias("pt"))
    out = s.join(pins, ["track", "id"], "left")
    return out.select("track", "id", F.coalesce("ps", "start").alias("start"), F.coalesce("pe", "stop").alias("stop"), F.coalesce("pt", "label").alias("text"), F.when(F.col("ps").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


@query(f"with {WORDS} select doc_id, pos, lower(word) as word, row_number() over (partition by doc_id, lower(word) order by pos) as nth from words")
def nth_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of its text a word is."""
    w = words(spark, sf_dir).withColumn("word", F.lower("word"))
    return w.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word", F.row_number().over(Window.partitionBy("doc_id", "word").orderBy("pos")).alias("nth"))


@query(f"""with {WORDS}, s as (select doc_id, pos, case when regexp_matches(word, '[éèêàçùœ]') then 'fr' when regexp_matches(word, '[äöüß]') then 'de' when regexp_matches(word, '[ñóíá]') then 'es' end as script from words),
r as (select *, pos - row_number() over (partition by doc_id, script order by pos) as run from s where script is not null), c as (select doc_id, script, run, count(*) as n from r group by all)
select doc_id, script, sum(n)::bigint as words, max(n) as longest from c group by doc_id, script having max(n) > 2 or sum(n) > 5""")
def second_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked words by language with the longest run, where a run or the total is large enough."""
    w, word = words(spark, sf_dir), F.col("word")
    script = F.when(word.rlike("[éèêàçùœ]"), "fr").when(word.rlike("[äöüß]"), "de").when(word.rlike("[ñóíá]"), "es")
    s = w.withColumn("script", script).filter("script is not null")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "script").orderBy("pos"))
    c = s.withColumn("run", run).groupBy("doc_id", "script", "run").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc_id", "script").agg(F.sum("n").alias("words"), F.max("n").alias("longest")).filter("longest > 2 or words > 5")


@query(f"""with {WORDS}, n as (select doc_id, pos, {NORM} as norm from words), w as (select list(norm) over (partition by doc_id order by pos rows between current row and 4 following) as w from n)
select array_to_string(list_slice(w, 1, k), ' ') as gram, k, count(*) as n from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k group by all having count(*) >= 3""")
def frequent_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to five words that occur three times or more over all documents."""
    return grams.frequent(table(spark, sf_dir, "documents"), "text", 3)


@query(f"""with {SPANS}, n as (select track, id, value, list(value) over (partition by track order by start, id rows between 2 preceding and 2 following exclude current row) as near from spans),
m as (select *, list_median(near) as mid from n) select track, id, case when len(near) = 0 or abs(value - mid) <= greatest(60, 3 * list_median(list_transform(near, lambda x: abs(x - mid)))) then value else mid end as value from m""")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values far from the median of their two neighbours on each side become that median."""
    w = _in_track()
    near = F.concat(F.collect_list("value").over(w.rowsBetween(-2, -1)), F.collect_list("value").over(w.rowsBetween(1, 2)))

    def median(x):
        s, n = F.array_sort(x), F.size(x)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    m = spans(spark, sf_dir).withColumn("near", near).withColumn("mid", median(F.col("near")))
    away = median(F.transform("near", lambda x: F.abs(x - F.col("mid"))))
    fine = (F.size("near") == 0) | (F.abs(F.col("value") - F.col("mid")) <= F.greatest(F.lit(60.0), 3 * away))
    return m.select("track", "id", F.when(fine, F.col("value")).otherwise(F.col("mid")).alias("value"))


@query(f"""with {SPANS}, l as (select track, id, start, value, lag(value) over w as b, lead(value) over w as a, max(value) over (partition by track) as peak from spans window w as (partition by track order by start, id))
select track, id, start from l where value >= 0.25 * peak and value - coalesce(b, 0) >= 0.2 * peak and value >= coalesce(a, 0)""")
def rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima that rise by a fifth of the track's peak."""
    w = _in_track()
    l_ = spans(spark, sf_dir).withColumn("b", F.lag("value").over(w)).withColumn("a", F.lead("value").over(w)).withColumn("peak", F.max("value").over(Window.partitionBy("track")))
    v = F.col("value")
    return l_.filter((v >= 0.25 * F.col("peak")) & (v - F.coalesce("b", F.lit(0)) >= 0.2 * F.col("peak")) & (v >= F.coalesce("a", F.lit(0)))).select("track", "id", "start")


@query(f"""with {WORDS}, l as (select doc_id, pos, word, sum(len(word) + 1) over (partition by doc_id order by pos) as upto from words) select doc_id, string_agg(word, ' ' order by pos) as prompt from l where upto <= 400 group by doc_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words up to a running length of 400."""
    upto = F.sum(F.length("word") + 1).over(Window.partitionBy("doc_id").orderBy("pos"))
    kept = words(spark, sf_dir).withColumn("upto", upto).filter("upto <= 400")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("prompt"))


@query("""with a as (select c_nationkey as name, max(c_acctbal) as v from customer group by 1), b as (select s_nationkey as name, max(s_acctbal) as v from supplier group by 1)
select coalesce(a.name, b.name) as name, case when a.name is null then 'new' when b.name is null then 'gone' else 'changed' end as change from a full join b on a.name = b.name where a.v is distinct from b.v""")
def stamp_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed, new and vanished entries between two stamps."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("an")).agg(F.max("c_acctbal").alias("av"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("bn")).agg(F.max("s_acctbal").alias("bv"))
    out = a.join(b, F.col("an") == F.col("bn"), "full").filter(~F.col("av").eqNullSafe(F.col("bv")))
    return out.select(F.coalesce("an", "bn").alias("name"), F.when(F.col("an").isNull(), "new").when(F.col("bn").isNull(), "gone").otherwise("changed").alias("change"))


@query("""select l_suppkey as key, count(*) as n, round((sum(l_quantity * l_linenumber) * count(*) - sum(l_quantity) * sum(l_linenumber)) / (sum(l_linenumber * l_linenumber) * count(*) - sum(l_linenumber) * sum(l_linenumber)), 9) as slope
from lineitem group by 1""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of a least-squares line by sums."""
    x, y, n = F.col("l_linenumber"), F.col("l_quantity"), F.count(F.lit(1))
    slope = (F.sum(y * x) * n - F.sum(y) * F.sum(x)) / (F.sum(x * x) * n - F.sum(x) * F.sum(x))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(n.alias("n"), F.round(slope, 9).alias("slope"))


@query("""with v as (select l_returnflag as a, l_linestatus as b, cast(sum(l_quantity) as bigint) as x from lineitem group by 1, 2), s as (select a, sum(x) as sa from v group by a), t as (select b, sum(x) as sb from v group by b)
select v.a, v.b, x, cast(x * 2 - sa - sb as bigint) as interaction from v join s using (a) join t using (b)""")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pair does beyond its two singles."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.sum("l_quantity").cast("bigint").alias("x"))
    sa, sb = F.sum("x").over(Window.partitionBy("a")), F.sum("x").over(Window.partitionBy("b"))
    return v.select("a", "b", "x", (F.col("x") * 2 - sa - sb).alias("interaction"))


@query(f"""with {SPANS}, f as (select *, first_value(start) over (partition by track, label order by id) as seen from spans) select track, label, min(start) as low, max(stop) as high, row_number() over (partition by track order by any_value(seen), label) as place from f group by track, label""")
def underlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer edges of each group, in the order in which groups first appear."""
    g = spans(spark, sf_dir).groupBy("track", "label").agg(F.min("start").alias("low"), F.max("stop").alias("high"), F.min_by("start", "id").alias("seen"))
    return g.select("track", "label", "low", "high", F.row_number().over(Window.partitionBy("track").orderBy("seen", "label")).alias("place"))


@query(f"""with {SPANS}, m as (select track, label, list_sort(list(stop - start))[count(*) // 2 + 1] as typical from spans group by all), j as (select s.track, s.id, s.stop - s.start as d, typical from spans s join m using (track, label))
select track, id, case when d < typical / 2 then 'shorter' when d > typical * 2 then 'longer' else 'none' end as reason from j""")
def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason code against the upper median of the label."""
    from ..operators.stats import upper_median

    s = spans(spark, sf_dir).withColumn("d", F.col("stop") - F.col("start"))
    m = s.groupBy("track", "label").agg(upper_median(F.col("d")).alias("typical"))
    reason = F.when(F.col("d") < F.col("typical") / 2, "shorter").when(F.col("d") > F.col("typical") * 2, "longer").otherwise("none")
    return s.join(m, ["track", "label"]).select("track", "id", reason.alias("reason"))


@query(f"""with {SPANS} select track, list_sort(list_distinct(list(label))) as every, list_sort(list_filter(list_distinct(list(label)), lambda x: x <> 'view')) as kept, count(*) filter (label = 'view') > 0 as has from spans group by track""")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of collected words, and what is left after one was removed."""
    every = F.array_sort(F.collect_set("label"))
    return spans(spark, sf_dir).groupBy("track").agg(every.alias("every"), F.filter(every, lambda x: x != "view").alias("kept"), (F.count_if(F.col("label") == "view") > 0).alias("has"))


@query(f"""with {SPANS}, d as (select distinct track, start // 86400000 as day from spans), r as (select track, day, day - row_number() over (partition by track order by day) as run from d)
select track, min(day) as first_day, max(day) as last_day, count(*) as days, lead(min(day)) over (partition by track order by min(day)) - max(day) - 1 as missing from r group by track, run""")
def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days with anything, and the days missing before the next run."""
    d = spans(spark, sf_dir).select("track", F.floor(F.col("start") / 86_400_000).alias("day")).distinct()
    r = d.withColumn("run", F.col("day") - F.row_number().over(Window.partitionBy("track").orderBy("day")))
    g = r.groupBy("track", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    nxt = F.lead("first_day").over(Window.partitionBy("track").orderBy("first_day"))
    return g.select("track", "first_day", "last_day", "days", (nxt - F.col("last_day") - 1).alias("missing"))
