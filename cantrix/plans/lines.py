"""Queries on heard words, lines and blocks: filters, statuses, windows, cuts, merges and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sequence
from ..sources.tables import table
from .base import HEARD, heard
from .catalog import query

#: DuckDB: whether ``word`` is a vocalise or one of them repeated.
VOCALISE = f"regexp_matches(regexp_replace(lower(word), '[^a-z]', '', 'g'), '^({'|'.join(f'({v})+' for v in T.VOCALISES)})$')"
#: Activity windows of a song: two of every five seconds.
WINDOWS = "windows as (select song, unnest(range(0, max(stop) // 5000 + 1)) as k from heard group by song), w as (select song, k * 5000 as low, k * 5000 + 2000 as high from windows)"
PERIOD, ON = 5000, 2000


def _song() -> Window:
    return Window.partitionBy("song").orderBy("pos")


def _joined(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")


def _windows(h: DataFrame) -> DataFrame:
    """The activity windows; words meet them by the number of their period, never all of a song's with all."""
    last = h.groupBy("song").agg(F.max("stop").alias("last"))
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / PERIOD))).alias("k")
    return last.select("song", k).select("song", "k", (F.col("k") * PERIOD).alias("low"), (F.col("k") * PERIOD + ON).alias("high"))


@query(f"with {HEARD} select song, pos, word, confidence, row_number() over (partition by song order by confidence, pos) as place from heard where confidence < 0.3")
def low_confidence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of low confidence, lowest first in each song."""
    low = heard(spark, sf_dir).filter("confidence < 0.3")
    return low.select("song", "pos", "word", "confidence", F.row_number().over(Window.partitionBy("song").orderBy("confidence", "pos")).cast("bigint").alias("place"))


@query(f"with {HEARD} select song, round(avg(coalesce(nullif(confidence, 0.5), 0)), 4) as certainty from heard group by song")
def mean_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of a song, a missing one as zero."""
    return heard(spark, sf_dir).groupBy("song").agg(F.round(F.avg(F.coalesce(F.nullif("confidence", F.lit(0.5)), F.lit(0.0))), 4).alias("certainty"))


@query(f"""with {HEARD} select song, line, count(*) as words, count(*) filter ({VOCALISE}) as vocalises, count(*) >= 3 and bool_and({VOCALISE}) as repeated, bool_or(not {VOCALISE}) as priority from heard group by song, line""")
def filler_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of vocalises alone, and lines with a real word."""
    v = T.is_vocalise(F.col("word"))
    return heard(spark, sf_dir).groupBy("song", "line").agg(F.count(F.lit(1)).alias("words"), F.count_if(v).alias("vocalises"), ((F.count(F.lit(1)) >= 3) & F.bool_and(v)).alias("repeated"), F.bool_or(~v).alias("priority"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
f as (select *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda word: word <> '' and not {VOCALISE})) = 0 and regexp_matches(line, '\\S') as filler from l)
select doc_id, string_agg(line, chr(10) order by n) filter (not filler) as text, count(*) filter (filler) as dropped from f group by doc_id""")
def without_filler_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without lines that are vocalises alone, as language detection reads them; null where nothing is left."""
    filler = lambda line: line.rlike(r"\S") & ~F.exists(T.split_words(line), lambda w: ~T.is_vocalise(w))
    every = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", every.alias("lines"), F.filter(every, lambda x: ~filler(x)).alias("kept"))
    return d.select("doc_id", F.when(F.size("kept") > 0, F.array_join("kept", "\n")).alias("text"), (F.size("lines") - F.size("kept")).cast("bigint").alias("dropped"))


@query(f"""with {HEARD}, z as (select *, len(word) <= 3 as zero, pos // 6 as instant from heard), f as (select *, case when zero and lag(zero) over s and lag(instant) over s = instant then 0 else 1 end as fresh from z window s as (partition by song, block order by pos)),
r as (select *, sum(fresh) over (partition by song, block order by pos) as run from f), n as (select *, count(*) over (partition by song, block, run) as members from r)
select song, block, string_agg(word, ' ' order by pos) as text, count(*) as words from n where not (zero and members >= 4) group by song, block""")
def without_repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without runs of four or more words of no length on one instant; a segment without words goes."""
    z = heard(spark, sf_dir).withColumn("zero", F.length("word") <= 3).withColumn("instant", F.floor(F.col("pos") / 6))
    w = Window.partitionBy("song", "block").orderBy("pos")
    same = F.col("zero") & F.coalesce(F.lag("zero").over(w) & (F.lag("instant").over(w) == F.col("instant")), F.lit(False))
    runs = sequence.islands(z, ["song", "block"], ["pos"], ~same, "run")
    kept = runs.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("song", "block", "run"))).filter(~(F.col("zero") & (F.col("members") >= 4)))
    return kept.groupBy("song", "block").agg(_joined("pos", "word").alias("text"), F.count(F.lit(1)).alias("words"))


@query(f"""with {HEARD}, m as (select song, median(stop - start) as middle, max(stop) - min(start) as span from heard group by song),
r as (select h.*, m.middle, m.span, len(word) >= 60 or (len(word) > 10 and stop - start > greatest(800, 1.5 * middle)) as loop from heard h join m using (song))
select song, count(*) filter (loop) as runaways, round(case when any_value(span) = 0 then 1.0 else coalesce(sum(stop - start) filter (loop), 0) / any_value(span) end, 9) as share, count(*) filter (not loop) as kept from r group by song""")
def runaway_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words far longer than the song's usual one, their share of its span, and what is left."""
    h = heard(spark, sf_dir)
    m = h.groupBy("song").agg(F.median(F.col("stop") - F.col("start")).alias("middle"), (F.max("stop") - F.min("start")).alias("span"))
    n, length = F.length("word"), F.col("stop") - F.col("start")
    r = h.join(m, "song").withColumn("loop", (n >= 60) | ((n > 10) & (length > F.greatest(F.lit(800), 1.5 * F.col("middle")))))
    time = F.coalesce(F.sum(F.when(F.col("loop"), length)), F.lit(0))
    share = F.when(F.any_value("span") == 0, 1.0).otherwise(time / F.any_value("span"))
    return r.groupBy("song").agg(F.count_if("loop").alias("runaways"), F.round(share, 9).alias("share"), F.count_if(~F.col("loop")).alias("kept"))


@query(f"""with {HEARD}, g as (select song, pos, lower(word) as a, lead(lower(word), 1) over s as b, lead(lower(word), 2) over s as c from heard window s as (partition by song order by pos))
select song, pos, a as word from g where a = b and b = c and len(a) <= 4""")
def chants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three words in a row are one word of at most four letters."""
    g = heard(spark, sf_dir).select("song", "pos", F.lower("word").alias("word"))
    near = g.withColumn("b", F.lead("word", 1).over(_song())).withColumn("c", F.lead("word", 2).over(_song()))
    return near.filter("word = b and b = c and length(word) <= 4").select("song", "pos", "word")


@query(f"""with {HEARD}, h as (select *, (start % 5000 <= 2100 or start % 5000 >= 4900) or (stop % 5000 <= 2100 or stop % 5000 >= 4900) as hit from heard)
select song, line, count(*) as words, round(avg(case when hit then 1.0 else 0.0 end), 9) as share from h group by song, line having avg(case when hit then 1.0 else 0.0 end) >= 0.5""")
def sung_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which half the words start or end within a tenth of a second of an activity window."""
    h = heard(spark, sf_dir)
    w = _windows(h).select("song", "k", "low", "high")
    ends = h.select("song", "pos", "line", F.explode(F.array("start", "stop")).alias("at"))
    # a window and the tenth of a second before the next one
    near = ends.withColumn("k", F.explode(F.array(F.floor(F.col("at") / PERIOD), F.floor((F.col("at") + 100) / PERIOD)))).join(w, ["song", "k"], "left")
    band = (F.col("at") >= F.col("k") * PERIOD - 100) & (F.col("at") <= F.col("k") * PERIOD + ON + 100)
    hit = near.groupBy("song", "line", "pos").agg(F.max(F.when(band, 1.0).otherwise(0.0)).alias("hit"))
    return hit.groupBy("song", "line").agg(F.count(F.lit(1)).alias("words"), F.round(F.avg("hit"), 9).alias("share")).filter("share >= 0.5")


@query(f"""with {HEARD}, {WINDOWS} select h.song, count(*) as words, count(w.low) as inside, round(100.0 * count(w.low) / count(*), 6) as percent
from heard h left join w on h.song = w.song and (h.start + h.stop) // 2 >= w.low and (h.start + h.stop) // 2 < w.high group by h.song""")
def residue_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose middle lies in an activity window, as a number and in percent."""
    h = heard(spark, sf_dir).withColumn("mid", F.floor((F.col("start") + F.col("stop")) / 2)).withColumn("k", F.floor(F.col("mid") / PERIOD))
    near = h.join(_windows(h).drop("low"), ["song", "k"], "left").withColumn("hit", F.col("mid") < F.col("high"))
    return near.groupBy("song").agg(F.count(F.lit(1)).alias("words"), F.count_if("hit").alias("inside"), F.round(100.0 * F.count_if("hit") / F.count(F.lit(1)), 6).alias("percent"))


@query(f"""with {HEARD}, l as (select song, line, min(start) as start, max(stop) as stop from heard group by song, line), {WINDOWS},
o as (select l.song, line, low, high, least(stop, high) - greatest(start, low) as common from l join w on l.song = w.song and w.low < l.stop and w.high > l.start)
select song, line, low, high, common from o qualify row_number() over (partition by song, line order by common desc, low) = 1""")
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line the activity window that it shares most time with."""
    h = heard(spark, sf_dir)
    lines = h.groupBy("song", "line").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    near = lines.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / PERIOD), F.floor(F.col("stop") / PERIOD)))).join(_windows(h), ["song", "k"])
    near = near.withColumn("common", F.least("stop", "high") - F.greatest("start", "low")).filter("low < stop and high > start")
    best = near.groupBy("song", "line").agg(F.min(F.struct((-F.col("common")).alias("less"), "low", "high")).alias("b"))
    return best.select("song", "line", "b.low", "b.high", (-F.col("b.less")).alias("common"))


@query(f"""with {HEARD}, m as (select song, median(stop - start) as middle, count(*) as n from heard group by song)
select song, pos, word from heard join m using (song) where n >= 3 and stop - start >= 350 and stop - start >= 2 * middle""")
def held_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words held for long, against the song's median."""
    h = heard(spark, sf_dir).withColumn("length", F.col("stop") - F.col("start"))
    m = h.groupBy("song").agg(F.median("length").alias("middle"), F.count(F.lit(1)).alias("n"))
    return h.join(m, "song").filter("n >= 3 and length >= 350 and length >= 2 * middle").select("song", "pos", "word")


STATUS = f"""{HEARD}, u as (select song, pos, word, confidence >= 0.3 as used, confidence = 0.2 as filtered, len(word) <= 4 as known from heard),
f as (select *, case when lag(used) over s = used then 0 else 1 end as fresh from u window s as (partition by song order by pos)), r as (select *, sum(fresh) over (partition by song order by pos) as run from f),
n as (select *, count(*) over (partition by song, run) as members, avg(case when known then 1.0 else 0.0 end) over (partition by song, run) as share from r)"""


@query(f"""with {STATUS} select song, pos, word, case when used then 'coupled' when members >= 4 and share >= 0.66 then 'repeat' when members >= 4 then 'suspect' when filtered then 'filtered' else 'no match' end as status from n""")
def found_word_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each heard word; long runs of uncoupled ones are repeats or suspect."""
    n = _runs(spark, sf_dir)
    status = F.when(F.col("used"), "coupled").when((F.col("members") >= 4) & (F.col("share") >= 0.66), "repeat").when(F.col("members") >= 4, "suspect").when(F.col("filtered"), "filtered").otherwise("no match")
    return n.select("song", "pos", "word", status.alias("status"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = heard(spark, sf_dir).select("song", "pos", "word", (F.col("confidence") >= 0.3).alias("used"), (F.col("confidence") == 0.2).alias("filtered"), (F.length("word") <= 4).alias("known"))
    runs = sequence.runs_of_equal(u, ["song"], ["pos"], F.col("used"), "run")
    own = Window.partitionBy("song", "run")
    return runs.withColumn("members", F.count(F.lit(1)).over(own)).withColumn("share", F.avg(F.when(F.col("known"), 1.0).otherwise(0.0)).over(own))


@query(f"""with {STATUS}, g as (select song, min(pos) as first, max(pos) as last, count(*) as members, string_agg(word, ' ' order by pos) as text from n where not used group by song, run having count(*) >= 3)
select *, (first - 1) // 8 as line from g qualify row_number() over (partition by song, (first - 1) // 8 order by first) = 1""")
def missing_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more uncoupled words, one report for each line, with their place and text."""
    g = _runs(spark, sf_dir).filter("not used").groupBy("song", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("members"), _joined("pos", "word").alias("text")).filter("members >= 3")
    return sequence.newest(g.withColumn("line", F.floor((F.col("first") - 1) / 8)), ["song", "line"], [F.asc("first")], 1).drop("run")


@query(f"""with {HEARD}, l as (select song, line, sum(greatest(1, len(regexp_extract_all(lower(word), '[aeiouyáéíóúàèêëïöüäæøåœ]+')))) as syllables, max(stop) - min(start) as length from heard group by song, line)
select song, line, cast(syllables as bigint) as syllables, round(syllables * 1000.0 / length, 6) as pace, syllables * 1000.0 / length > 8 as squeezed, syllables * 1000.0 / length between 0.6 and 8 as plausible from l""")
def line_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables per second of each line, squeezed above 8, plausible from 0.6 to 8."""
    own = F.sum(T.syllable_count(F.col("word"))).alias("syllables")
    lines = heard(spark, sf_dir).groupBy("song", "line").agg(own, (F.max("stop") - F.min("start")).alias("length"))
    pace = F.col("syllables") * 1000.0 / F.col("length")
    return lines.select("song", "line", "syllables", F.round(pace, 6).alias("pace"), (pace > 8).alias("squeezed"), pace.between(0.6, 8).alias("plausible"))


@query(f"""with {HEARD}, c as (select *, len(word) // 2 as cut from heard), s as (select song, pos, 0 as part, left(word, cut) as text, start, start + (stop - start) * cut // len(word) as stop from c where len(word) >= 6
union all select song, pos, 1, right(word, len(word) - cut), start + (stop - start) * cut // len(word), stop from c where len(word) >= 6 union all select song, pos, 0, word, start, stop from c where len(word) < 6) select song, row_number() over (partition by song order by pos, part) as pos, text, start, stop from s""")
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more cut in two rows at the middle, time in proportion; rows are numbered anew."""
    n, cut = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    at = F.col("start") + F.floor((F.col("stop") - F.col("start")) * cut / n)
    piece = lambda part, text, start, stop: F.struct(F.lit(part).alias("part"), text.alias("text"), start.alias("start"), stop.alias("stop"))
    two = F.array(piece(0, F.substring("word", F.lit(1), cut), F.col("start"), at), piece(1, F.substring("word", cut + 1, n), at, F.col("stop")))
    one = F.array(piece(0, F.col("word"), F.col("start"), F.col("stop")))
    rows = heard(spark, sf_dir).select("song", "pos", F.explode(F.when(n >= 6, two).otherwise(one)).alias("p"))
    return rows.select("song", F.row_number().over(Window.partitionBy("song").orderBy("pos", "p.part")).cast("bigint").alias("pos"), "p.text", "p.start", "p.stop")


@query(f"with {HEARD} select song, (pos - 1) // 2 + 1 as pos, string_agg(word, '' order by pos) as text, min(start) as start, max(stop) as stop from heard group by song, (pos - 1) // 2")
def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two adjacent words as one."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), "")
    pair = F.floor((F.col("pos") - 1) / 2)
    return heard(spark, sf_dir).groupBy("song", pair.alias("pair")).agg(text.alias("text"), F.min("start").alias("start"), F.max("stop").alias("stop")).select("song", (F.col("pair") + 1).alias("pos"), "text", "start", "stop")


@query(f"""with {HEARD}, p as (select *, cast(sum(case when pos % 3 = 1 then 1 else 0 end) over (partition by song, line order by pos) as bigint) as number from heard)
select song, line, number, string_agg(word, '' order by pos) as text, min(start) as start, max(stop) as stop, count(*) >= 2 as stressed from p group by song, line, number""")
def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces put together to words at their leading boundary; words of two pieces or more carry a stress on the first."""
    p = heard(spark, sf_dir).withColumn("number", F.sum(F.when(F.col("pos") % 3 == 1, 1).otherwise(0)).over(Window.partitionBy("song", "line").orderBy("pos")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), "")
    return p.groupBy("song", "line", "number").agg(text.alias("text"), F.min("start").alias("start"), F.max("stop").alias("stop"), (F.count(F.lit(1)) >= 2).alias("stressed"))


@query(f"""with {HEARD}, t as (select song, line, pos, len(word) as weight, min(start) over l as low, max(stop) over l as high, sum(len(word)) over (partition by song, line order by pos) as upto, sum(len(word)) over l as total from heard window l as (partition by song, line))
select song, line, pos, round(low + (high - low) * (upto - weight) / total, 4) as start, round(low + (high - low) * upto / total, 4) as stop, round((upto - weight / 2.0) / total, 6) as middle from t""")
def redistributed_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's span shared out among its pieces by weight, and each piece's relative middle."""
    line = Window.partitionBy("song", "line")
    t = heard(spark, sf_dir).withColumn("weight", F.length("word")).withColumn("low", F.min("start").over(line)).withColumn("high", F.max("stop").over(line))
    t = t.withColumn("upto", F.sum("weight").over(line.orderBy("pos"))).withColumn("total", F.sum("weight").over(line))
    at = lambda x: F.round(F.col("low") + (F.col("high") - F.col("low")) * x / F.col("total"), 4)
    return t.select("song", "line", "pos", at(F.col("upto") - F.col("weight")).alias("start"), at(F.col("upto")).alias("stop"), F.round((F.col("upto") - F.col("weight") / 2.0) / F.col("total"), 6).alias("middle"))


@query(f"""with {HEARD}, l as (select song, block, line, string_agg(word, ' ' order by pos) as text, min(start) as start from heard group by song, block, line)
select song, block, count(*) as lines, string_agg(text, ' / ' order by line) as text, sha1(string_agg(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '' order by line)) as mark from l group by song, block""")
def song_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together to blocks in order, with a mark of the normalised text."""
    lines = heard(spark, sf_dir).groupBy("song", "block", "line").agg(_joined("pos", "word").alias("text"))
    every = F.array_sort(F.collect_list(F.struct("line", "text")))
    blocks = lines.groupBy("song", "block").agg(F.count(F.lit(1)).alias("lines"), every.alias("every"))
    bare = F.array_join(F.transform("every", lambda x: T.letters_and_digits(x["text"])), "")
    return blocks.select("song", "block", "lines", F.array_join(F.transform("every", lambda x: x["text"]), " / ").alias("text"), F.sha1(F.encode(bare, "UTF-8")).alias("mark"))


@query(f"""with {HEARD}, b as (select song, block, count(distinct line) as lines from heard group by song, block), n as (select song - 1 as song, block, lines from b)
select coalesce(b.song, n.song) as song, coalesce(b.block, n.block) as block, b.lines as own, n.lines as other, b.lines is not distinct from n.lines as same from b full join n on b.song = n.song and b.block = n.block where coalesce(b.song, n.song) >= 0""")
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each block in two texts, a song's and the next one's, by position."""
    b = heard(spark, sf_dir).groupBy("song", "block").agg(F.count_distinct("line").alias("own"))
    n = b.select((F.col("song") - 1).alias("song"), "block", F.col("own").alias("other"))
    return b.join(n, ["song", "block"], "full").filter("song >= 0").withColumn("same", F.col("own").eqNullSafe(F.col("other")))


@query(f"""with {HEARD}, a as (select song, pos, word from heard where pos % 5 <> 0), b as (select song, pos, word as found, start, confidence from heard where pos % 7 <> 0)
select coalesce(a.song, b.song) as song, coalesce(a.pos, b.pos) as pos, word, found, case when found is null then 'not found' when word is null then 'extra' when confidence >= 0.3 then 'coupled' else 'estimated' end as status from a full join b on a.song = b.song and a.pos = b.pos""")
def word_coupling_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and found words side by side, with a status each."""
    h = heard(spark, sf_dir)
    a, b = h.filter("pos % 5 <> 0").select("song", "pos", "word"), h.filter("pos % 7 <> 0").select("song", "pos", F.col("word").alias("found"), "confidence")
    status = F.when(F.col("found").isNull(), "not found").when(F.col("word").isNull(), "extra").when(F.col("confidence") >= 0.3, "coupled").otherwise("estimated")
    return a.join(b, ["song", "pos"], "full").select("song", "pos", "word", "found", status.alias("status"))


@query(f"""with {HEARD}, s as (select song, line, min(start) as low, max(stop) as high from heard group by song, line), o as (select song, line, low, high, coalesce(lag(high) over (partition by song order by line), 0) as after, lead(low) over (partition by song order by line) as before from s)
select song, line, low, high, after, before, case when low - after >= 300 and low >= after then low - 150 else low end as moved from o""")
def line_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The room around each line, and its start moved ahead where a real pause comes before."""
    s = heard(spark, sf_dir).groupBy("song", "line").agg(F.min("start").alias("low"), F.max("stop").alias("high"))
    w = Window.partitionBy("song").orderBy("line")
    o = s.withColumn("after", F.coalesce(F.lag("high").over(w), F.lit(0))).withColumn("before", F.lead("low").over(w))
    return o.withColumn("moved", F.when((F.col("low") - F.col("after") >= 300) & (F.col("low") >= F.col("after")), F.col("low") - 150).otherwise(F.col("low")))


@query(f"""with {HEARD}, l as (select song, line, row_number() over (partition by song order by line) - 1 as n, count(*) over (partition by song) as total, max(max(stop)) over (partition by song) as duration from heard group by song, line)
select song, line, 8000 + 10 * n * (duration - 16000) // (10 * total) as start, 8000 + (10 * n + 8) * (duration - 16000) // (10 * total) as stop, n * 7 // total as original from l where duration > 16000""")
def even_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without times in even slots from 8 s on to 8 s before the end, 80 % filled, and their proportional place among seven."""
    lines = heard(spark, sf_dir).groupBy("song", "line").agg(F.max("stop").alias("stop"))
    own = Window.partitionBy("song")
    n = lines.withColumn("n", F.row_number().over(own.orderBy("line")) - 1).withColumn("total", F.count(F.lit(1)).over(own)).withColumn("duration", F.max("stop").over(own)).filter("duration > 16000")
    at = lambda tenths: F.expr(f"8000 + (10 * n + {tenths}) * (duration - 16000) div (10 * total)")
    return n.select("song", "line", at(0).alias("start"), at(8).alias("stop"), F.floor(F.col("n") * 7 / F.col("total")).alias("original"))


@query(f"""with {HEARD}, l as (select song, block, line, line % 4 as place, min(start) as start, min(confidence) as reliable from heard group by song, block, line), o as (select *, min(start) over (partition by song, block) as first from l)
select song, place, count(*) as repeats, round(median(start - first), 4) as offset_ms, count(*) filter (reliable >= 0.1) as heard from o group by song, place""")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line position the median start after the block's first, over all repeats."""
    lines = heard(spark, sf_dir).groupBy("song", "block", "line").agg(F.min("start").alias("start"), F.min("confidence").alias("reliable")).withColumn("place", F.col("line") % 4)
    o = lines.withColumn("first", F.min("start").over(Window.partitionBy("song", "block")))
    return o.groupBy("song", "place").agg(F.count(F.lit(1)).alias("repeats"), F.round(F.median(F.col("start") - F.col("first")), 4).alias("offset_ms"), F.count_if(F.col("reliable") >= 0.1).alias("heard"))


@query(f"""with {HEARD}, l as (select song, block, pos % 32 as place, word, case when confidence >= 0.3 then start - block * 12800 end as time from heard), b as (select song, place, min_by(time, block) filter (time is not null) as known from l group by song, place)
select l.song, l.block, l.place, l.word, coalesce(time, known) as time, time is null and known is not null as filled from l left join b on l.song = b.song and l.place = b.place""")
def filled_from_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a time take that of the same place in the first repeat that has one."""
    l_ = heard(spark, sf_dir).select("song", "block", (F.col("pos") % 32).alias("place"), "word", F.when(F.col("confidence") >= 0.3, F.col("start") - F.col("block") * 12800).alias("time"))
    b = l_.filter("time is not null").groupBy("song", "place").agg(F.min_by("time", "block").alias("known"))
    return l_.join(b, ["song", "place"], "left").select("song", "block", "place", "word", F.coalesce("time", "known").alias("time"), (F.col("time").isNull() & F.col("known").isNotNull()).alias("filled"))


@query(f"""with {HEARD}, l as (select song, line, lower(string_agg(word, ' ' order by pos)) as text, list(stop - start order by pos) as profile from heard group by song, line), n as (select *, lag(profile) over (partition by song, text order by line) as before from l)
select song, line, round(list_avg(list_transform(range(1, len(profile) + 1), lambda i: abs(profile[i] / list_sum(profile) - before[i] / list_sum(before)))), 9) as difference from n where before is not null and len(before) = len(profile)""")
def repetition_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the relative lengths between a line and the one before with the same text and number of words."""
    profile = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("stop") - F.col("start")).alias("n")))), lambda x: x["n"].cast("double"))
    l_ = heard(spark, sf_dir).groupBy("song", "line").agg(F.lower(_joined("pos", "word")).alias("text"), profile.alias("p"))
    n = l_.withColumn("before", F.lag("p").over(Window.partitionBy("song", "text").orderBy("line"))).filter("before is not null and size(before) = size(p)")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    apart = F.zip_with(F.col("p"), F.col("before"), lambda x, y: F.abs(x / total(F.col("p")) - y / total(F.col("before"))))
    return n.select("song", "line", F.round(total(apart) / F.size("p"), 9).alias("difference"))


@query(f"""with {HEARD} select word, count(*) as n from heard where confidence < 0.3 group by word order by n desc, word limit 25""")
def uncoupled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 words that most often find no partner."""
    return heard(spark, sf_dir).filter("confidence < 0.3").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query(f"""with {HEARD}, m as (select *, stop - start as length, median(stop - start) over (partition by song, line) as middle from heard)
select song, pos, word, length, middle from m where length >= 350 and length >= 1.8 * middle order by length desc, song, pos limit 20""")
def held_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 pieces held longest against the median of their line."""
    h = heard(spark, sf_dir).withColumn("length", F.col("stop") - F.col("start"))
    m = h.groupBy("song", "line").agg(F.median("length").alias("middle"))
    return h.join(m, ["song", "line"]).filter("length >= 350 and length >= 1.8 * middle").orderBy(F.desc("length"), "song", "pos").limit(20).select("song", "pos", "word", "length", "middle")
