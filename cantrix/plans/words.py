"""Queries on words: frequencies, keys, filters, runs and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import spelled
from ..operators.sequence import runs_of_equal
from ..sources.tables import table
from .base import NORM, WORDS, words
from .catalog import query

#: DuckDB: the sound key of ``norm``; RE2 has no back references, so doubles are folded letter by letter.
KEY = """replace(list_aggregate(list_filter(string_split(LETTERS, ''), lambda c, i: i = 1 or c = 'x' or string_split(LETTERS, '')[i - 1] <> c), 'string_agg', ''), 'x', 'ks')"""


def duck_key(column: str) -> str:
    """DuckDB: sound key of a column."""
    s = f"regexp_replace(lower({column}), '[^\\p{{L}}]', '', 'g')"
    for a, b in T.DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"replace(replace(translate({s}, '{''.join(T.LETTERS)}', '{''.join(T.LETTERS.values())}'), 'h', ''), 'r', '')"
    return f"coalesce({KEY.replace('LETTERS', s)}, '')"


def duck_fold(key: str) -> str:
    """DuckDB: the unit that a key repeats."""
    return f"coalesce(substring({key}, 1, list_filter(range(1, greatest(2, cast(floor(len({key}) / 2) as int) + 1)), lambda n: n * 2 <= len({key}) and substring({key}, n + 1) = substring({key}, 1, len({key}) - n))[1]), {key})"


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).withColumn("norm", T.normalize_word(F.col("word"))).filter("norm != ''")


def _counted(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Normalised words with ``n``; each spelling is counted as it stands first, so expressions run once for a spelling."""
    raw = words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *more)
    return raw.withColumn("norm", T.normalize_word(F.col("word"))).filter("norm != ''")


@query(f"""with {WORDS}, n as (select {NORM} as norm from words), f as (select norm, count(*) as n from n where norm <> '' group by norm),
k as (select {duck_key("norm")} as sound, norm, n from f)
select sound, sum(n)::bigint as heard, count(*) as spellings, min(norm) as first_spelling from k where sound <> '' group by sound""")
def sound_key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sound key is heard, and in how many spellings; keys are made once per spelling."""
    counts = _counted(spark, sf_dir).groupBy("norm").agg(F.sum("n").alias("n"))
    keyed = counts.select(T.sound_key(F.col("norm")).alias("sound"), "norm", "n").filter("sound != ''")
    return keyed.groupBy("sound").agg(F.sum("n").alias("heard"), F.count(F.lit(1)).alias("spellings"), F.min("norm").alias("first_spelling"))


@query(f"with {WORDS}, n as (select {NORM} as norm from words) select norm as word, count(*) as n from n where norm <> '' group by 1")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised words by how often they occur."""
    return _counted(spark, sf_dir).groupBy(F.col("norm").alias("word")).agg(F.sum("n").alias("n"))


@query(f"""with {WORDS}, n as (select {NORM} as norm, doc_id, pos from words), f as (select norm as word, count(*) as n, min(doc_id * 1000000 + pos) as seen from n where norm <> '' group by 1)
select word, n, row_number() over (order by n desc, seen) as place from f order by place limit 25""")
def most_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most frequent words; ties in order of first appearance."""
    seen = F.min(F.col("doc_id") * 1000000 + F.col("pos"))
    top = _counted(spark, sf_dir, seen.alias("seen")).groupBy(F.col("norm").alias("word")).agg(F.sum("n").alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("n"), "seen").limit(25)
    return top.select("word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).alias("place"))


@query(f"with {WORDS}, n as (select {NORM} as norm from words) select norm as word, count(*) as n from n where norm <> '' and len(norm) <= 3 group by 1")
def short_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of words of at most three letters."""
    return _counted(spark, sf_dir).filter(F.length("norm") <= 3).groupBy(F.col("norm").alias("word")).agg(F.sum("n").alias("n"))


@query(f"""with {WORDS}, n as (select doc_id, lang, {NORM} as norm from words)
select lang, count(distinct doc_id) as segments, count(*) as words, count(distinct norm) filter (norm <> '') as unique_words, count(*) filter (norm <> '' and len(norm) <= 3) as short_words,
round(avg(len(norm)), 4) as average_letters from n group by lang""")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts per language."""
    w = words(spark, sf_dir).withColumn("norm", T.normalize_word(F.col("word")))
    return w.groupBy("lang").agg(
        F.countDistinct("doc_id").alias("segments"), F.count(F.lit(1)).alias("words"), F.countDistinct(F.when(F.col("norm") != "", F.col("norm"))).alias("unique_words"),
        F.count_if((F.col("norm") != "") & (F.length("norm") <= 3)).alias("short_words"), F.round(F.avg(F.length("norm")), 4).alias("average_letters"),
    )


@query(f"""with {WORDS}, n as (select doc_id, {NORM} as norm from words), b as (select distinct unnest(string_split(lower(text), ' ')) as w from benchmark),
k as (select distinct {duck_key("w")} as sound from b), d as (select doc_id, {duck_key("norm")} as sound from n where norm <> '')
select doc_id, count(*) as words, count(k.sound) as known from d left join k using (sound) group by doc_id""")
def words_in_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, words whose sound key occurs in the reference texts."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(T.sound_key(F.col("w")).alias("sound")).distinct().withColumn("hit", F.lit(1))
    # a document's words are counted first; keys are made and looked up once for each spelling
    own = words(spark, sf_dir).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    spelling = own.select("word").distinct().withColumn("norm", T.normalize_word(F.col("word"))).filter("norm != ''")
    spelling = spelling.select("word", T.sound_key(F.col("norm")).alias("sound")).join(known, "sound", "left").select("word", "hit")
    return own.join(spelling, "word").groupBy("doc_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).alias("known"))


@query(f"""with {WORDS}, n as (select distinct {NORM} as norm from words), k as (select distinct {duck_key("norm")} as a from n where norm <> ''), f as (select a, {duck_fold("a")} as fa from k where regexp_full_match(a, '[a-z]+')),
r as (select distinct {duck_key("x")} as b from (values ('kedeng'), ('gedengedeng'), ('koffie'), ('thee'), ('tion'), ('eau')) v(x)), g as (select b, {duck_fold("b")} as fb from r)
select a, b, round(case when a = b then 1.0 when fa = fb then 0.95 when least(len(fa), len(fb)) >= 3 and (contains(fa, fb) or contains(fb, fa)) then least(len(fa), len(fb)) / greatest(len(fa), len(fb)) else 1.0 - levenshtein(fa, fb) / greatest(len(fa), len(fb)) end, 9) as similarity
from f, g where similarity >= 0.5""")
def similar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound keys of all documents that resemble one of six search words (a literal table); plain letters, as the oracle's distance counts bytes."""
    keys = _normal(spark, sf_dir).select("norm").distinct().select(T.sound_key(F.col("norm")).alias("a")).filter(F.col("a").rlike("^[a-z]+$")).distinct().withColumn("fa", T.folded(F.col("a")))
    search = spark.createDataFrame([(x,) for x in ("kedeng", "gedengedeng", "koffie", "thee", "tion", "eau")], "x string").select(T.sound_key(F.col("x")).alias("b")).distinct().withColumn("fb", T.folded(F.col("b")))
    both = keys.join(F.broadcast(search), F.lit(True))
    return both.select("a", "b", F.round(T.key_similarity(F.col("a"), F.col("b"), F.col("fa"), F.col("fb")), 9).alias("similarity")).filter("similarity >= 0.5")


@query(r"""select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as bare, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as spaced from documents""")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the filters and the line comparison see them."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.letters_and_digits(F.col("text")).alias("bare"), T.single_spaced(F.col("text")).alias("spaced"))


@query(f"""with {WORDS} select doc_id, count(*) as words, count(*) filter (not regexp_matches(word, '[\\p{{L}}\\p{{N}}]')) as symbols,
count(*) filter (regexp_matches(regexp_replace(lower(word), '[^a-z]', '', 'g'), '^({"|".join(f"({v})+" for v in T.VOCALISES)})$')) as vocalises,
count(*) filter (regexp_matches(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '^[0-9]+$')) as numbers from words group by doc_id""")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, vocalises and pure numbers among the words."""
    w = F.col("word")
    return words(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(T.is_symbol(w)).alias("symbols"), F.count_if(T.is_vocalise(w)).alias("vocalises"), F.count_if(T.is_pure_number(w)).alias("numbers"))


@query(f"""with {WORDS}, n as (select doc_id, pos, {NORM} as norm from words), k as (select *, {duck_key("norm")} as sound from n where norm <> ''),
r as (select *, pos - row_number() over (partition by doc_id, sound order by pos) as run from k)
select doc_id, sound, min(pos) as first_pos, count(*) as times from r where sound <> '' group by doc_id, sound, run having count(*) >= 3""")
def chanted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound keys that come three times or more back to back."""
    k = _normal(spark, sf_dir).withColumn("sound", T.sound_key(F.col("norm"))).filter("sound != ''")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "sound").orderBy("pos"))
    return k.withColumn("run", run).groupBy("doc_id", "sound", "run").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times")).filter("times >= 3").drop("run")


@query(f"""with {WORDS}, n as (select doc_id, pos, {NORM} as norm from words), k as (select *, {duck_key("norm")} as sound from n where norm <> ''),
l as (select *, lag(sound) over (partition by doc_id order by pos) as before from k) select distinct sound from l where sound = before and sound <> ''""")
def doubled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that follow themselves somewhere."""
    k = _normal(spark, sf_dir).withColumn("sound", T.sound_key(F.col("norm")))
    before = F.lag("sound").over(Window.partitionBy("doc_id").orderBy("pos"))
    return k.withColumn("before", before).filter("sound = before and sound != ''").select("sound").distinct()


@query(f"""with {WORDS}, f as (select word, len(word) as n from words) select word, count(*) as n, list_filter(list_transform(string_split(word, '-'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}''’]', '', 'g')), lambda x: x <> '') as parts,
greatest(1, len(regexp_extract_all(lower(word), '[aeiouyáéíóúàèêëïöüäæøåœ]+'))) as syllables, substring(sha1(word), 1, 16) as content_id, regexp_replace(trim(word), '[^A-Za-z0-9._\\-]+', '_', 'g') as safe from f group by word""")
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts between hyphens, syllables, content id and file-safe form of the words of all documents."""
    w = F.col("word")
    f = words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return f.select("word", "n", T.hyphen_parts(w).alias("parts"), T.syllable_count(w).cast("bigint").alias("syllables"), T.content_id(w).alias("content_id"), T.safe_name(w).alias("safe"))


@query("""with r as (select distinct l_partkey as n from lineitem),
u as (select ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] as u, ['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] as t)
select n, concat_ws(' ', case when n >= 1000 then u[n // 1000 + 1] || ' thousand' end, case when n % 1000 >= 100 then u[n % 1000 // 100 + 1] || ' hundred' end,
case when n = 0 then 'zero' when n % 100 = 0 then null when n % 100 < 20 then u[n % 100 + 1] when n % 10 = 0 then t[n % 100 // 10 + 1] else t[n % 100 // 10 + 1] || ' ' || u[n % 10 + 1] end) as english from r, u""")
def numbers_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers written out in English."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select("n", spelled(F.col("n"), "en").alias("english"))


@query(f"""with {WORDS}, n as (select doc_id, pos, {NORM} as norm from words), b as (select distinct {NORM.replace("word", "w")} as norm from (select unnest(regexp_split_to_array(text, '\\s+')) as w from benchmark) where w <> '')
select doc_id, n.norm as word, count(*) as n from n where norm <> '' and norm not in (select norm from b) group by all""")
def words_not_in_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no reference text has."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.split_words(F.col("text"))).alias("w")).select(T.normalize_word(F.col("w")).alias("norm")).distinct()
    return _normal(spark, sf_dir).join(known, "norm", "left_anti").groupBy("doc_id", F.col("norm").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as run from conversations)
select conv_id, role, min(turn) as first_turn, count(*) as turns, string_agg(text, ' ' order by turn) as text from t group by conv_id, role, run""")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one role as one segment."""
    runs = runs_of_equal(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("conv_id", "role", "part").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), text.alias("text")).drop("part")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
b as (select *, regexp_matches(line, '\S') as filled from l), s as (select *, case when filled and not coalesce(lag(filled) over w, false) then 1 else 0 end as fresh from b window w as (partition by doc_id order by n))
select doc_id, n as line_number, cast(sum(fresh) over (partition by doc_id order by n) as bigint) as block from s where filled qualify true""".replace(" where filled qualify true", ""))
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block number of every line: a blank line ends a block."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    filled = lines.withColumn("filled", F.col("line").rlike(r"\S"))
    fresh = (F.col("filled") & ~F.coalesce(F.lag("filled").over(w), F.lit(False))).cast("int")
    block = filled.withColumn("fresh", fresh).withColumn("block", F.sum("fresh").over(w))
    return block.select("doc_id", (F.col("n") + 1).cast("bigint").alias("line_number"), F.col("block").cast("bigint").alias("block"))


@query(f"""with {WORDS}, n as (select doc_id, lang, pos, {NORM} as norm from words), f as (select lang, norm, min(doc_id * 1000000 + pos) as seen from n where norm <> '' group by all)
select lang, norm as word from f qualify row_number() over (partition by lang order by seen) <= 40""")
def prompt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-occurrence distinct words of each language, at most 40."""
    f = _normal(spark, sf_dir).groupBy("lang", "norm").agg(F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("seen"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("seen"))).filter("place <= 40").select("lang", F.col("norm").alias("word"))


@query(r"""select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, regexp_replace(regexp_replace(regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1), '[_\-]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as shown, coalesce(try_cast(nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), '') as bigint), 1) as version from pages""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable name and trailing number of each address; 1 where there is no number."""
    p = table(spark, sf_dir, "pages")
    last = F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1)
    shown = F.regexp_replace(F.regexp_replace(last, r"[_\-]+", " "), r"^\s+|\s+$", "")
    number = F.regexp_extract("url", r"([0-9]+)(?:[?#].*)?$", 1)
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), shown.alias("shown"), F.coalesce(F.when(number != "", number).try_cast("bigint"), F.lit(1)).alias("version"))
