"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing to target weights, packing.

Each stage takes the documents that the one before wrote and returns what it keeps, with the
columns of ``documents``; the last returns packed pieces. Whoever writes a stage's result holds its
texts, so each stage sets the session's batches small (``arrow.BATCHES``) and leaves them so; ``run``
puts them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantrix.llm.arrow import bound_batches, cut, drop, small_batches
from cantrix.llm.jaccard import jaccard_components
from cantrix.llm.line_dedup import line_dedup
from cantrix.llm.mixing import mix
from cantrix.llm.packing import pack
from cantrix.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    A null or empty text is scored as a text without terms, a very long one by all its terms. Every row is
    judged on its own, so repeated rows stay or go together; a null doc_id is kept. Empty tables give no rows.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text.

    Rows with a null text or source stay as they are. A line above the ratio goes wherever it stands, so ties
    need no rule; repeated rows are pages of their own. Empty tables give no rows.
    """
    bound_batches(spark)
    out = line_dedup(docs.select(*COLUMNS), least_pages=2)
    return out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id, null last, then the smallest hash of the row; of equal rows, one.

    Groups are of rows, so two unlinked texts under one doc_id, or under none, both stay. Texts without a
    word (null, empty) link with nothing and all stay. Empty tables give no rows.
    """
    bound_batches(spark)
    marked = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_mark"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_mark").alias("mark"))
    groups = jaccard_components(marked.withColumn("_row", row), key="_row")
    kept = groups.filter("n_shingles > 0 and _row = component_id").select(F.col("_row.mark").alias("_mark")).distinct()
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    # equal rows become one before they are shuffled
    worded = marked.filter(~blank).dropDuplicates(["_mark"]).join(kept, "_mark", "left_semi")
    return worded.unionByName(marked.filter(blank)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts without a word have size 0; of rows of one source and size, hashes of key and text decide which are
    taken more often, so reruns agree. A null source is one of its own. Empty tables give no rows.
    """
    bound_batches(spark)
    copies = mix(docs, keep=["text", "lang", "source", "n_chars"])
    return copies.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 1024 tokens.

    A null or empty text is its end token alone, a very long one several pieces; copies are packed as often as
    they occur. Empty tables give no rows.
    """
    bound_batches(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Models, components and packing have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again; read ones go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for number, (_, stage) in enumerate(STAGES):
            before, docs = docs, cut(stage(spark, docs, sf_dir))
            if number:
                drop(before)
    return docs
