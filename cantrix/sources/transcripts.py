"""Readers and writers for transcripts, reference texts and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<text:string,start:double,end:double,confidence:double>"
SEGMENT = f"index int, text string, start double, end double, origin string, words array<{WORD}>"
TIMED_LINE = "line int, text string, quality string, block int, crowd boolean, bg boolean, syllables array<struct<text:string,start:double,end:double>>"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of segments with nested words; malformed input is an error, a missing origin empty."""
    df = spark.read.schema(SEGMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("origin", F.coalesce("origin", F.lit("")))


def segment_words(segments: DataFrame) -> DataFrame:
    """One row per word, with its segment and position."""
    return segments.select(F.col("index").alias("segment"), F.posexplode("words").alias("pos", "w")).select("segment", "pos", "w.*")


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """Timed lines of either layout: a bare list, or an object with ``lines``."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw"))
    line = f"array<struct<{TIMED_LINE.replace(' int', ':int').replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array').replace(', ', ',')}>>"
    bare = F.from_json("raw", line)
    inside = F.from_json("raw", f"struct<lines:{line}>")["lines"]
    return raw.select(F.explode(F.when(F.col("raw").startswith("["), bare).otherwise(inside)).alias("l")).select("l.*")


def parse_lines(text: DataFrame, by: list[str], value: str = "line", number: str = "n") -> DataFrame:
    """Reference lines with block, crowd and background flags; comments and blank lines go.

    ``[crowd]`` and ``[bg]`` stay in force until their end marker, across lines.
    """
    w = Window.partitionBy(*by).orderBy(number)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = text.withColumn("_blank", F.trim(value) == "").filter(~F.ltrim(F.col(value)).startswith("#"))
    t = t.withColumn("_fresh", (~F.col("_blank") & F.coalesce(F.lag("_blank").over(w), F.lit(True))).cast("int")).withColumn("block", F.sum("_fresh").over(run))
    for name in ("crowd", "bg"):
        opened, closed = F.regexp_count(value, F.lit(rf"\[{name}\]")), F.regexp_count(value, F.lit(rf"\[/{name}\]"))
        t = t.withColumn(f"_{name}", opened - closed).withColumn(name, (F.sum(f"_{name}").over(run) > 0) | (opened > 0)).drop(f"_{name}")
    bare = F.trim(F.regexp_replace(value, r"\[/?(?:crowd|bg)\]", ""))
    return t.withColumn(value, bare).filter(F.col(value) != "").drop("_blank", "_fresh")


def write_words_csv(words: DataFrame, path: str) -> None:
    """Semicolons, a header, three decimals for times and four for confidence."""
    fixed = [F.format_string(f"%.{n}f", F.bround(c, n)).alias(c) for c, n in (("start", 3), ("end", 3), ("confidence", 4))]
    words.select("text", *fixed).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as JSON lines; an empty origin is left out."""
    segments.withColumn("origin", F.expr("nullif(origin, '')")).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
