"""Queries on jobs, workers, versions and trials: queue states, estimates, order, invalidation and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import table
from .base import SPANS, spans
from .catalog import query
from .evaluation import ERRORS, errors

#: DuckDB: orders as jobs of a worker; the state follows from the order's status.
JOBS = """jobs as (select o_orderkey as job, o_custkey % 40 as worker, o_orderpriority as kind, o_totalprice as seconds, o_orderdate as queued, case o_orderstatus when 'O' then 'waiting' when 'P' then 'claimed' else 'done' end as state from orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a worker."""
    state = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 40).alias("worker"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("seconds"), F.col("o_orderdate").alias("queued"), state.alias("state"))


@query(f"""with {JOBS}, l as (select distinct l_orderkey as job from lineitem) select l.job, bool_or(state = 'waiting') as waiting, bool_or(state = 'claimed') as claimed, bool_or(state = 'done') as done, count(jobs.job) > 0 as known from l left join jobs on l.job = jobs.job group by l.job""")
def known_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job is waiting, claimed or done, or unknown to the queue."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job")).distinct()
    held = jobs(spark, sf_dir).select("job", "state")
    return ids.join(held, "job", "left").groupBy("job").agg(*(F.bool_or(F.col("state") == s).alias(s) for s in ("waiting", "claimed", "done")), (F.count("state") > 0).alias("known"))


@query("""select l_orderkey as job, l_linenumber as answer, l_suppkey as worker from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_suppkey) = 1""")
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer to a job wins; later ones are dropped."""
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_suppkey")).alias("a")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(first).select("job", F.col("a.l_linenumber").alias("answer"), F.col("a.l_suppkey").alias("worker"))


@query(f"""with {JOBS}, e as (select job, job - 7 as needs from jobs where job % 3 = 0) select job, worker, kind from jobs where state = 'waiting' and not exists (select 1 from e join jobs p on e.needs = p.job where e.job = jobs.job and p.state <> 'done')""")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs all of whose predecessors are done."""
    j = jobs(spark, sf_dir)
    edges = j.filter("job % 3 = 0").select("job", (F.col("job") - 7).alias("needs"))
    open_ = edges.join(j.filter("state <> 'done'").select(F.col("job").alias("needs")), "needs").select("job")
    return j.filter("state = 'waiting'").join(open_, "job", "left_anti").select("job", "worker", "kind")


SPEEDS = f"""{JOBS}, own as (select worker, kind, avg(seconds) as mean, count(*) as n from jobs where state = 'done' and worker % 3 <> 0 or state = 'done' and kind <> '5-LOW' group by worker, kind)"""


def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs(spark, sf_dir).filter("state = 'done' and (worker % 3 <> 0 or kind <> '5-LOW')")
    return done.groupBy("worker", "kind").agg(F.avg("seconds").alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""with {SPEEDS}, r as (select worker, median(ratio) as ratio from (select a.worker, a.mean / avg(b.mean) as ratio from own a join own b on a.kind = b.kind and a.worker <> b.worker group by a.worker, a.kind, a.mean) group by worker),
o as (select kind, list_sort(list(mean)) as means from own group by kind), w as (select distinct worker from jobs), k as (select distinct kind from jobs)
select w.worker, k.kind, round(coalesce(own.mean, means[len(means) // 2 + 1] * coalesce(ratio, 1)), 4) as expected, own.mean is null as guessed from w cross join k left join own on own.worker = w.worker and own.kind = k.kind left join o on o.kind = k.kind left join r on r.worker = w.worker""")
def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected seconds of each kind of job on each worker: its own mean, else the upper median of all means by its usual ratio.

    The mean over the others comes from sums, so no worker meets another.
    """
    own = _speeds(spark, sf_dir)
    both = own.join(own.groupBy("kind").agg(F.sum("mean").alias("sum"), F.count(F.lit(1)).alias("members")), "kind").filter("members > 1")
    ratio = both.withColumn("ratio", F.col("mean") / ((F.col("sum") - F.col("mean")) / (F.col("members") - 1))).groupBy("worker").agg(F.median("ratio").alias("ratio"))
    usual = own.groupBy("kind").agg(stats.upper_median(F.col("mean")).alias("usual"))
    j = jobs(spark, sf_dir)
    kinds = j.agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # five kinds, one row
    every = j.select("worker").distinct().join(F.broadcast(kinds)).select("worker", F.explode("kinds").alias("kind"))
    out = every.join(own.select("worker", "kind", "mean"), ["worker", "kind"], "left").join(F.broadcast(usual), "kind", "left").join(ratio, "worker", "left")
    return out.select("worker", "kind", F.round(F.coalesce("mean", F.col("usual") * F.coalesce("ratio", F.lit(1.0))), 4).alias("expected"), F.col("mean").isNull().alias("guessed"))


@query(f"""with {SPEEDS}, b as (select kind, min(mean) as best, arg_min(worker, (mean, worker)) as fastest from own group by kind) select job, jobs.worker, fastest, b.best < 0.8 * own.mean as share from jobs join own on own.worker = jobs.worker and own.kind = jobs.kind join b on b.kind = jobs.kind where state = 'waiting'""")
def worth_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs that some worker does in under 80 % of the owner's time."""
    own = _speeds(spark, sf_dir)
    best = own.groupBy("kind").agg(F.min(F.struct("mean", "worker")).alias("b")).select("kind", F.col("b.mean").alias("best"), F.col("b.worker").alias("fastest"))
    waiting = jobs(spark, sf_dir).filter("state = 'waiting'").join(own.select("worker", "kind", "mean"), ["worker", "kind"]).join(best, "kind")
    return waiting.select("job", "worker", "fastest", (F.col("best") < 0.8 * F.col("mean")).alias("share"))


@query(f"""with {JOBS} select job, worker, row_number() over (partition by worker order by seconds desc, job) as place, round(sum(seconds) over (partition by worker order by seconds desc, job), 2) as until from jobs where state = 'waiting'""")
def heaviest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs of each worker, longest first, and when each would be done."""
    w = Window.partitionBy("worker").orderBy(F.desc("seconds"), "job")
    return jobs(spark, sf_dir).filter("state = 'waiting'").select("job", "worker", F.row_number().over(w).cast("bigint").alias("place"), F.round(F.sum("seconds").over(w), 2).alias("until"))


@query(f"""with {JOBS}, d as (select worker from jobs group by worker having count(*) filter (state = 'claimed') > 10) select job, worker, case when state = 'claimed' and worker not in (select worker from d) then 'waiting' else state end as state, state = 'claimed' and worker not in (select worker from d) as released from jobs where not (state = 'waiting' and worker % 5 = 0)""")
def released_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs of a run are withdrawn; claims of workers that hold few go back to waiting."""
    j = jobs(spark, sf_dir)
    busy = j.groupBy("worker").agg((F.count_if(F.col("state") == "claimed") > 10).alias("busy"))
    left = j.filter("not (state = 'waiting' and worker % 5 = 0)").join(busy, "worker")
    back = (F.col("state") == "claimed") & ~F.col("busy")
    return left.select("job", "worker", F.when(back, "waiting").otherwise(F.col("state")).alias("state"), back.alias("released"))


@query(f"""with {JOBS}, m as (select max(queued) as now from jobs) select job, queued, datediff('day', queued, now) as age, strftime(queued, '%Y%m%d-%H%M%S') as stamp from jobs, m where datediff('day', queued, now) <= 30""")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the last 30 days, their age and a stamp as in file names."""
    j = jobs(spark, sf_dir)
    now = j.agg(F.max("queued").alias("now"))  # one row
    age = F.datediff(F.col("now"), F.col("queued"))
    return j.join(F.broadcast(now)).filter(age <= 30).select("job", "queued", age.cast("bigint").alias("age"), F.date_format("queued", "yyyyMMdd-HHmmss").alias("stamp"))


@query(f"""with {JOBS}, o as (select *, lag(queued) over (partition by worker order by queued, job) as before from jobs) select worker, count(*) as jobs, count(*) filter (before is not null and epoch(queued) - epoch(before) < 86400 * 20) as too_soon, min(queued) as first, max(queued) as last from o group by worker""")
def too_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that follow the worker's one before within a settling time."""
    o = jobs(spark, sf_dir).withColumn("before", F.lag("queued").over(Window.partitionBy("worker").orderBy("queued", "job")))
    soon = F.unix_timestamp("queued") - F.unix_timestamp("before") < 86400 * 20
    return o.groupBy("worker").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(soon).alias("too_soon"), F.min("queued").alias("first"), F.max("queued").alias("last"))


@query(f"""with {JOBS}, x as (select worker, list(seconds order by queued, job) as xs from jobs where state = 'done' group by worker)
select worker, len(xs) as n, round(list_reduce(xs, lambda m, x, i: m + (x - m) / least(i, 10)), 4) as mean from x""")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seconds of a worker as noted job by job, the count capped at ten: an exponential mean from there on."""
    order = F.array_sort(F.collect_list(F.struct("queued", "job", "seconds")))
    x = jobs(spark, sf_dir).filter("state = 'done'").groupBy("worker").agg(order.alias("xs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"))

    def note(state, x):
        n = state["n"] + 1
        return F.struct(n.alias("n"), (state["mean"] + (x["seconds"] - state["mean"]) / F.least(n, F.lit(10))).alias("mean"))

    return x.select("worker", F.size("xs").cast("bigint").alias("n"), F.round(F.aggregate("xs", start, note)["mean"], 4).alias("mean"))


@query(f"""with {JOBS}, x as (select worker, list(seconds order by queued, job) as xs from jobs group by worker) select worker, case when len(xs) < 10 then null else len(list_distinct(list_transform(xs[4:len(xs) - 3], lambda x: cast(floor(x / 100000) as bigint)))) > 2 end as varies from x""")
def varying_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than two distinct sizes without three at the head and the tail; null under ten."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("queued", "job", "seconds"))), lambda x: F.floor(x["seconds"] / 100000))
    x = jobs(spark, sf_dir).groupBy("worker").agg(order.alias("xs"))
    inner = F.slice("xs", F.lit(4), F.greatest(F.size("xs") - 6, F.lit(0)))
    return x.select("worker", F.when(F.size("xs") >= 10, F.size(F.array_distinct(inner)) > 2).alias("varies"))


@query("""with e as (select distinct l_suppkey as source, l_orderkey as product from lineitem), n as (select product, count(*) as sources, min(source) as source from e group by product) select product, source from n where sources = 1 and source % 2 = 0""")
def direct_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with exactly one source, which is in the set."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("product")).distinct()
    return e.groupBy("product").agg(F.count(F.lit(1)).alias("sources"), F.min("source").alias("source")).filter("sources = 1 and source % 2 = 0").select("product", "source")


@query("""with g as (select l_suppkey as number, l_partkey as block, min(l_linenumber) as size from lineitem group by all), f as (select block, min(number) as number from g group by block), s as (select g.number, g.block, p.p_size % 4 as size from g join f using (block, number) join part p on p.p_partkey = g.block),
k as (select number, size, count(*) as members from s group by all having count(*) >= 2) select s.number, s.block, s.size, members - 1 as partners from s join k using (number, size)""")
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of blocks: the first group keeps a member, only equal sizes stay together, two at least; with the number of partners."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("block")).agg(F.min("l_suppkey").alias("number"))
    s = g.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), (F.col("p_size") % 4).alias("size")), "block")
    k = s.groupBy("number", "size").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    return s.join(k, ["number", "size"]).select("number", "block", "size", (F.col("members") - 1).alias("partners"))


@query("""select c_custkey as project, c_nationkey as step from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def projects_without_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that have a step and no stored result of the wanted state."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("step"))
    return c.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project")).distinct(), "project", "left_anti")


@query(f"""with {ERRORS}, b as (select kind, avg(error) as all_mean from errors group by kind), s as (select kind, line, sum(error) as part, count(*) as n from errors group by kind, line), t as (select kind, sum(part) as part, sum(n) as n from s group by kind)
select s.kind, s.line, round((t.part - s.part) / (t.n - s.n) - all_mean, 6) as delta from s join t using (kind) join b using (kind) where t.n > s.n""")
def omission_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaving one line number out does to a kind's mean error; the rest comes from the sums, not from new runs."""
    s = errors(spark, sf_dir).groupBy("kind", "line").agg(F.sum("error").alias("part"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("kind")
    t = s.withColumn("whole", F.sum("part").over(own)).withColumn("all", F.sum("n").over(own)).filter("all > n")
    delta = (F.col("whole") - F.col("part")) / (F.col("all") - F.col("n")) - F.col("whole") / F.col("all")
    return t.select("kind", "line", F.round(delta, 6).alias("delta"))


@query(f"""with {ERRORS}, o as (select song, line, min(error) as before from errors group by song, line), v as (select song, line + 1 as line, min(error) as now from errors group by song, line)
select song, count(*) as paired, count(*) filter (now <> before) as moved, count(*) filter (now < before - 100) as better, count(*) filter (now > before + 100) as worse, count(*) filter (now <> before) = 0 as flat from o join v using (song, line) group by song""")
def line_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant's lines against the baseline's: moved, better and worse ones, and whether nothing moved."""
    e = errors(spark, sf_dir).groupBy("song", "line").agg(F.min("error").alias("before"))
    v = e.select("song", (F.col("line") + 1).alias("line"), F.col("before").alias("now"))
    moved = F.count_if(F.col("now") != F.col("before"))
    return e.join(v, ["song", "line"]).groupBy("song").agg(F.count(F.lit(1)).alias("paired"), moved.alias("moved"), F.count_if(F.col("now") < F.col("before") - 100).alias("better"), F.count_if(F.col("now") > F.col("before") + 100).alias("worse"), (moved == 0).alias("flat"))


@query(f"""with {ERRORS}, v as (select part % 7 as variant, avg(error) as distance, avg(case when error <= 100000 then 1.0 else 0.0 end) as share, count(*) as covered from errors where part % 7 <> 6 group by 1 union all select 6, null, avg(case when error <= 100000 then 1.0 else 0.0 end), count(*) from errors where part % 7 = 6)
select variant, round(distance, 4) as distance, round(share, 9) as share, covered, row_number() over (order by distance is null, distance, share desc, variant) as place from v""")
def ranked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by distance, then share; those without a reference come last. Seven rows are ranked."""
    variant = F.col("part") % 7
    distance = F.avg(F.when(variant != 6, F.col("error")))
    v = errors(spark, sf_dir).groupBy(variant.alias("variant")).agg(distance.alias("distance"), stats.share_within(F.col("error"), 100_000).alias("share"), F.count(F.lit(1)).alias("covered"))
    place = F.row_number().over(Window.orderBy(F.col("distance").asc_nulls_last(), F.desc("share"), "variant")).cast("bigint")
    return v.select("variant", F.round("distance", 4).alias("distance"), F.round("share", 9).alias("share"), "covered", place.alias("place"))


@query(f"""with {ERRORS} select kind, round(avg(error) filter (words >= 25), 6) as moved, round(avg(error) filter (words < 25), 6) as untouched, count(*) filter (error > 200000) as damaged, count(*) filter (error > 200000) > 0 as broken, round(avg(error) filter (line = 1), 6) as flagged from errors group by kind""")
def damage_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error on moved and untouched rows, damaged rows, and whether any counter is above zero."""
    mean = lambda c: F.round(F.avg(F.when(c, F.col("error"))), 6)
    damaged = F.count_if(F.col("error") > 200_000)
    return errors(spark, sf_dir).groupBy("kind").agg(mean(F.col("words") >= 25).alias("moved"), mean(F.col("words") < 25).alias("untouched"), damaged.alias("damaged"), (damaged > 0).alias("broken"), mean(F.col("line") == 1).alias("flagged"))


@query(f"""with {SPANS}, m as (select track, label, max(id) as version from spans group by all), l as (select track, max(version) as newest from m group by track)
select m.track, label, newest - version as versions_ago, substr(sha1(concat_ws('|', m.track, label, version)), 1, 12) as mark from m join l on m.track = l.track""")
def versions_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each label's last run lies behind the track's newest, and a fingerprint of its state."""
    m = spans(spark, sf_dir).groupBy("track", "label").agg(F.max("id").alias("version"))
    newest = F.max("version").over(Window.partitionBy("track"))
    mark = F.substring(F.sha1(F.encode(F.concat_ws("|", "track", "label", "version"), "UTF-8")), 1, 12)
    return m.select("track", "label", (newest - F.col("version")).alias("versions_ago"), mark.alias("mark"))


@query(f"""with {SPANS} select id, greatest(start, 1704100000000) as low, least(greatest(stop, start), 1705000000000) as high, case when abs(start % 3600000) <= 60000 then start - start % 3600000 else start end as snapped, round(least(1.0, greatest(0.0, (1704500000000 - start) / cast(stop - start + 1 as double))), 6) as progress,
case when start < 1704500000000 and 1704500000000 - start <= 3600000 then cast(ceil((1704500000000 - start) / 1200000.0) as bigint) end as countdown, case when confidence >= 0.03 then round(value * (1 - confidence) / confidence, 4) end as remaining from spans""")
def timing_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped spans, starts snapped to the hour, progress at a moment, a countdown, and the time left by the share done."""
    moment, left = 1704500000000, F.lit(1704500000000) - F.col("start")
    s = spans(spark, sf_dir)
    return s.select(
        "id", F.greatest("start", F.lit(1704100000000)).alias("low"), F.least(F.greatest("stop", "start"), F.lit(1705000000000)).alias("high"),
        F.when(F.abs(F.col("start") % 3600000) <= 60000, F.col("start") - F.col("start") % 3600000).otherwise(F.col("start")).alias("snapped"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left / (F.col("stop") - F.col("start") + 1).cast("double"))), 6).alias("progress"),
        F.when((F.col("start") < moment) & (left <= 3600000), F.ceil(left / 1200000.0)).alias("countdown"),
        F.when(F.col("confidence") >= 0.03, F.round(F.col("value") * (1 - F.col("confidence")) / F.col("confidence"), 4)).alias("remaining"),
    )


@query("""with p as (select p_partkey as id, p_name as text, p_size as n from part) select id, string_split(text, ' ')[1] as first, case when n % 2 = 0 then text || ' (' || n || ')' else text end as shown, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(string_split(text, ' ')[1] || string_split(text, ' ')[2], '[^A-Za-z0-9]', '', 'g')) as identical,
case when n >= 20 then 'linked' when n >= 10 then 'shape' else 'single' end as kind, n % 10 = 0 and cast(round_even(n / 10.0, 0) as bigint) % 2 = 0 as spread from p""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of blocks, whether two normalised texts are equal, and evenly spread picks by banker's rounding."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_size").alias("n"))
    w = F.split("text", " ")
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return p.select(
        "id", w[0].alias("first"), F.when(F.col("n") % 2 == 0, F.concat("text", F.lit(" ("), "n", F.lit(")"))).otherwise(F.col("text")).alias("shown"), (bare(F.col("text")) == bare(F.concat(w[0], w[1]))).alias("identical"),
        F.when(F.col("n") >= 20, "linked").when(F.col("n") >= 10, "shape").otherwise("single").alias("kind"), ((F.col("n") % 10 == 0) & (F.bround(F.col("n") / 10.0).cast("bigint") % 2 == 0)).alias("spread"),
    )


@query("""with s as (select page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages) select page_id, regexp_replace(url, '^http://', 'https://') as moved, host, string_split(host, '.')[1] as project, split_part(split_part(url, '?', 1), '.', -1) in ('html', 'htm') as page from s""")
def moved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses under a new prefix, with host and project."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    kind = F.element_at(F.split(F.split("url", r"\?")[0], r"\."), -1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^http://", "https://").alias("moved"), host.alias("host"), F.split(host, r"\.")[0].alias("project"), kind.isin("html", "htm").alias("page"))
