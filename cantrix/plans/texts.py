"""Queries that need row-by-row state: alignment and clustering of words. Held against brute force in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align
from ..sources.tables import table
from .base import songs
from .catalog import query


@query()
def aligned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each user turn aligned with those of the answer that follows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.split_words(F.lower("text")).alias("words"))
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("answer"))
    pairs = c.filter("role = 'user'").join(answer, ["conv_id", "turn"]).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return align.aligned(pairs, "key", "words", "answer")


@query()
def sound_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound key of a document, grouped by leader within the document."""
    return align.leaders_in_texts(songs(spark, sf_dir), "song", "texts").withColumnRenamed("song", "doc_id")
