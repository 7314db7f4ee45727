"""Views of the driver's tables in the data model of the library, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..sources.tables import table

#: DuckDB: events as spans of a track, in whole milliseconds, as ``spans`` below.
SPANS = """spans as (
  select user_id as track, event_id as id, event_type as label, epoch_us(ts) // 1000 as start,
         epoch_us(ts) // 1000 + cast(floor(value * 100000) as bigint) as stop, value, least(value / 500, 1) as confidence
  from events
)"""
#: DuckDB: words of documents with their position from 1.
WORDS = r"""words as (
  select doc_id, lang, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos
  from (select doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)
)"""
#: DuckDB: the normalised form of ``word``.
NORM = r"""regexp_replace(regexp_replace(lower(word), '[^\p{L}\p{N}''’\-]', '', 'g'), '^[''’\-]+|[''’\-]+$', '', 'g')"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of a track (the user): start and stop in whole milliseconds."""
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.col("event_type").alias("label"),
        at.alias("start"), (at + F.floor(F.col("value") * 100000).cast("bigint")).alias("stop"), "value", F.least(F.col("value") / 500, F.lit(1)).alias("confidence"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their position from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(split_words(F.col("text"))).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


#: DuckDB: words with made-up times in whole milliseconds, in lines of 8 and blocks of 32 words, as ``heard`` below.
HEARD = f"""{WORDS}, heard as (select doc_id as song, pos, word, (pos - 1) // 8 as line, (pos - 1) // 32 as block, pos * 400 + (len(word) * 37) % 150 as start,
  pos * 400 + (len(word) * 37) % 150 + 100 + 60 * len(word) as stop, ((len(word) * 7) % 10) / 10.0 as confidence from words)"""


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as heard words of a song, with times that follow from place and length."""
    n = F.length("word")
    start = F.col("pos") * 400 + (n * 37) % 150
    return words(spark, sf_dir).select(
        F.col("doc_id").alias("song"), F.col("pos").cast("bigint").alias("pos"), "word", F.floor((F.col("pos") - 1) / 8).alias("line"), F.floor((F.col("pos") - 1) / 32).alias("block"),
        start.cast("bigint").alias("start"), (start + 100 + 60 * n).cast("bigint").alias("stop"), (((n * 7) % 10) / 10.0).cast("double").alias("confidence"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs as ``texts``, an array for each: a document is a row already, only documents that share an id are brought together."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song"), "text")
    shared = F.broadcast(d.groupBy(F.col("song").alias("_song")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    same = F.col("song").eqNullSafe(F.col("_song"))
    more = d.join(shared, same, "left_semi").groupBy("song").agg(F.collect_list("text").alias("texts"))
    return d.join(shared, same, "left_anti").select("song", F.array("text").alias("texts")).unionByName(more)
