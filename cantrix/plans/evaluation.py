"""Queries on measurements: paired errors, tallies, history, pivots, dependency graphs, vectors and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import graph, nearest, sequence, stats
from ..sources.tables import table
from .base import SPANS, spans
from .catalog import query

#: Paired errors: order lines, "automatic" price per unit against the part's list price.
ERRORS = """errors as (select l_orderkey as song, l_linenumber as line, l_partkey as part, l_returnflag as kind, l_linestatus as state, l_quantity as words,
  cast(floor(100 * abs(l_extendedprice / l_quantity - p_retailprice)) as bigint) as error from lineitem join part on l_partkey = p_partkey)"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's error against its reference, in cents."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    error = F.floor(100 * F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))).cast("bigint")
    return both.select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("state"), F.col("l_quantity").alias("words"), error.alias("error"))


@query(f"with {ERRORS} select kind, state, count(error) as n, round(avg(error), 6) as avg, median(error) as med, max(error) as max from errors group by grouping sets ((kind, state), (kind), ())")
def paired_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error figures per block, per kind and over all."""
    out = errors(spark, sf_dir).groupingSets([["kind", "state"], ["kind"], []], "kind", "state").agg(*stats.error_figures(F.col("error")))
    return out.withColumn("avg", F.round("avg", 6))


@query(f"""with {ERRORS} select coalesce(kind, 'all') as kind, count(*) as lines, round(avg(case when error <= 100000 then 1.0 else 0.0 end), 9) as near, round(avg(least(error, 200000)), 6) as capped, count(*) filter (error > 200000) as above
from errors group by rollup(kind)""")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of small errors, mean of capped ones and number of large ones, by kind and over all."""
    e = F.col("error")
    out = errors(spark, sf_dir).rollup("kind").agg(F.count(F.lit(1)).alias("lines"), F.round(stats.share_within(e, 100_000), 9).alias("near"), F.round(F.avg(F.least(e, F.lit(200_000))), 6).alias("capped"), F.count_if(e > 200_000).alias("above"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(f"""with {ERRORS}, o as (select song, part, min(error) as before from errors where state = 'O' group by all), v as (select song, part, min(error) as now from errors where state = 'F' group by all),
j as (select song, before, now from o join v using (song, part)), a as (select song, part, error, count(*) over (partition by part) as n from errors)
select count(*) as lines, count(distinct song) as songs, count(*) filter (song % 2 = 0) as even, (select count(*) from a where n > 40) as common, (select count(*) from j) as paired from a""")
def baseline_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a variant's lines compare with the baseline's on common lines."""
    e = errors(spark, sf_dir)
    before = e.filter("state = 'O'").groupBy("song", "part").agg(F.min("error").alias("before"))
    now = e.filter("state = 'F'").groupBy("song", "part").agg(F.min("error").alias("now"))
    paired = before.join(now, ["song", "part"]).agg(F.count(F.lit(1)).alias("paired"))
    counted = e.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 40, F.col("n"))), F.lit(0)).alias("common"))
    every = e.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("song").alias("songs"), F.count_if(F.col("song") % 2 == 0).alias("even"))
    return every.crossJoin(counted).crossJoin(paired)


@query(f"""with {ERRORS}, s as (select song, kind, sum(words) as w, sum(error * words) as x from errors group by all) select kind, count(*) as songs, round(sum(x) / greatest(sum(w), 1), 6) as weighted from s group by kind""")
def weighted_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error weighted by the lines that moved."""
    s = errors(spark, sf_dir).groupBy("song", "kind").agg(F.sum("words").alias("w"), F.sum(F.col("error") * F.col("words")).alias("x"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("songs"), F.round(F.sum("x") / F.greatest(F.sum("w"), F.lit(1)), 6).alias("weighted"))


@query(f"""with {ERRORS}, m as (select song, kind, median(error) as m from errors group by all) select kind, count(*) as blocks, round(avg(case when m <= 100000 then 1.0 else 0.0 end), 9) as good from m group by kind""")
def block_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of blocks whose median error is small."""
    m = errors(spark, sf_dir).groupBy("song", "kind").agg(F.median("error").alias("m"))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.round(stats.share_within(F.col("m"), 100_000), 9).alias("good"))


@query("""select c_nationkey as project, count(*) filter (c_mktsegment = 'BUILDING') as building, count(*) filter (c_mktsegment = 'MACHINERY') as machinery, count(*) filter (c_mktsegment = 'HOUSEHOLD') as household from customer group by 1""")
def version_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each version, with zeros for what is missing."""
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("project")).pivot("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"]).agg(F.count(F.lit(1)))
    return p.select("project", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("BUILDING", "MACHINERY", "HOUSEHOLD")))


@query("""with o as (select o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
select o_custkey as key, o_orderkey as version, o_orderstatus as stamp from o where o_orderstatus is distinct from before""")
def changed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp is kept only where it differs from the one before."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf_dir, "orders").withColumn("before", before)
    return o.filter(~F.col("o_orderstatus").eqNullSafe(F.col("before"))).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("stamp"))


@query("""with recursive e as (select n_regionkey as parent, 100 + n_nationkey as child from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer),
r(node) as (select 1 union select child from e join r on e.parent = r.node) select node from r""")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on region 1."""
    return graph.closure(_edges(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("parent"), (100 + F.col("n_nationkey")).cast("bigint").alias("child"))
    c = table(spark, sf_dir, "customer").select((100 + F.col("c_nationkey")).cast("bigint").alias("parent"), (1000 + F.col("c_custkey")).cast("bigint").alias("child"))
    return n.unionByName(c)


@query("""with recursive e as (select n_regionkey as parent, 100 + n_nationkey as child from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer),
r(node) as (select 1 union select child from e join r on e.parent = r.node), k(node) as (select 101 union select child from e join k on e.parent = k.node) select node from r except select node from k""")
def invalidation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on region 1 but not on nation 1."""
    root = lambda n: spark.range(n, n + 1).select(F.col("id").alias("node"))
    return graph.invalidation(_edges(spark, sf_dir), root(1), root(101))


@query("""with recursive p as (select distinct o_custkey as a, o_custkey // 3 * 3 as b from orders), e as (select a as u, b as v from p union select b, a from p),
r(node, label) as (select u, u from e union select e.v, r.label from r join e on e.u = r.node) select node, min(label) as label from r group by node""")
def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of pairs, by their smallest member."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_custkey") / 3) * 3).alias("b")).distinct()
    return graph.components(p)


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), q as (select vec_id as q, e as qe from v where vec_id % 20 = 0)
select q, vec_id, round(list_dot_product(qe, e) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(e, e))), 6) as cosine from q, v where vec_id <> q qualify row_number() over (partition by q order by cosine desc, vec_id) <= 10""")
def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors to each whose id is divisible by 20. Blocks of queries meet blocks of rows, and a pair of blocks leaves ten rows a query."""
    v = table(spark, sf_dir, "embeddings").filter("vec_id is not null").select("vec_id", "embedding")
    q = v.filter("vec_id % 20 = 0")
    return sequence.newest(nearest.top_cosines(nearest.blocks(q, "vec_id", "embedding"), nearest.blocks(v, "vec_id", "embedding"), 10), ["q"], [F.desc("cosine"), F.asc("vec_id")], 10)


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), m as (select *, list_avg(e) as m, sqrt(list_avg(list_transform(e, lambda x: x * x))) as rms from v)
select vec_id, round(rms, 6) as rms, round(20 * log10(greatest(rms, 1e-7)), 4) as db, round((e[1] - m) / greatest(sqrt(list_avg(list_transform(e, lambda x: (x - m) * (x - m)))), 1e-8), 5) as first_standardized from m""")
def vector_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square, decibels and first standardised component."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.rms(e), 6).alias("rms"), F.round(V.decibels(V.rms(e)), 4).alias("db"), F.round(F.get(V.standardized(e), F.lit(0)), 5).alias("first_standardized"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), p as (select a.vec_id, a.e as x, b.e as y from v a join v b on b.vec_id = a.vec_id + 1)
select vec_id, round(10 * log10(list_dot_product(x, x) / list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))), 5) as sdr from p""")
def distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal to distortion of each vector against the next."""
    v = table(spark, sf_dir, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(V.distortion_ratio(F.col("embedding"), F.col("other")), 5).alias("sdr"))


@query("""with x as (select label, unnest(range(1, 65)) as i, unnest(embedding) as x from embeddings) select label, i as position, round(avg(cast(x as double)), 6) as mean, round(median(cast(x as double)), 6) as median from x group by all""")
def mean_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise mean and median by label."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label", (F.col("i") + 1).cast("bigint").alias("position")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"))


@query("""select o_orderkey as job, o_orderpriority as priority, o_orderdate as queued, row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderkey) as place from orders qualify place = 1""")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that each worker takes next: most urgent, then oldest."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).filter("place = 1").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued"), "place")


@query(f"""with {SPANS}, c as (select track, label, count(*) as n, sum(value) as total, count(distinct id % 4) as devices from spans group by all),
o as (select track, label, total / n as mean from c), x as (select label, avg(mean) as rough from o group by label)
select c.track, c.label, n, round(total, 4) as seconds, devices, round(total / n - rough, 6) as against_others from c join o using (track, label) join x using (label)""")
def worker_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total and devices per worker and class, and its mean against the unweighted mean of all workers."""
    c = spans(spark, sf_dir).groupBy("track", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_distinct(F.col("id") % 4).alias("devices"))
    x = c.groupBy("label").agg(F.avg(F.col("total") / F.col("n")).alias("rough"))
    return c.join(x, "label").select("track", "label", "n", F.round("total", 4).alias("seconds"), "devices", F.round(F.col("total") / F.col("n") - F.col("rough"), 6).alias("against_others"))


@query("""with n as (select s_suppkey, s_acctbal, row_number() over (order by s_acctbal, s_name) - 1 as place, count(*) over () as n from supplier)
select s_suppkey as id, place, least(2, place * 3 // n) as third, place % 3 = 2 as held_out from n""")
def thirds_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ranked by error, cut in thirds, every third one held out. No task sorts all of them."""
    ranked = sequence.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name"), [F.asc("s_acctbal"), F.asc("s_name")])
    n = ranked.join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return n.select(F.col("s_suppkey").alias("id"), "place", F.least(F.lit(2), F.floor(F.col("place") * 3 / F.col("n"))).alias("third"), (F.col("place") % 3 == 2).alias("held_out"))


@query("""select distinct on (event_id) event_id, event_type, value from events order by event_id""")
def published_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by id, once each."""
    return table(spark, sf_dir, "events").dropDuplicates(["event_id"]).select("event_id", "event_type", "value")


@query("""select p_partkey as id, p_retailprice as seconds, cast(cast(floor(round_even(p_retailprice * 10, 0)) as bigint) // 600 as varchar) || ':' || lpad(cast(cast(round_even(p_retailprice * 10, 0) as bigint) % 600 // 10 as varchar), 2, '0') || '.' || cast(cast(round_even(p_retailprice * 10, 0) as bigint) % 10 as varchar) as shown,
case when p_size < 10 then 96000 when abs(128000 - p_size * 5000) <= abs(192000 - p_size * 5000) then 128000 else 192000 end as rate from part""")
def clock_and_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as m:ss.s, and the nearest of a fixed list of rates."""
    p = table(spark, sf_dir, "part")
    near = V.nearest_of(F.col("p_size") * 5000.0, [128000.0, 192000.0], 192000.0).cast("int")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("seconds"), T.clock(F.col("p_retailprice")).alias("shown"), F.when(F.col("p_size") < 10, 96000).otherwise(near).alias("rate"))
