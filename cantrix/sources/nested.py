"""Nested JSON both ways: clusters, regions, intervals and lines as structs, and documents of steps as maps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as pj
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTER = "struct<id:bigint,label:string,members:array<struct<text:string,count:bigint>>,occurrences:array<struct<start:double,stop:double,text:string,confidence:double,segment:bigint>>,segments:array<bigint>>"
REGION = "struct<start:double,stop:double,offset:double,confidence:double>"
INTERVAL = "struct<start:double,stop:double,label:string>"
LINE = "struct<text:string,start:double,stop:double,quality:string,crowd:boolean,background:boolean,disabled:boolean,pieces:array<struct<text:string,start:double,stop:double,stress:boolean>>>"


#: ``CLUSTER`` in Arrow's terms, without what occurrences hold besides.
OCCURRENCE = pa.struct([("start", pa.float64()), ("stop", pa.float64()), ("text", pa.string()), ("confidence", pa.float64()), ("segment", pa.int64())])
CLUSTERS = pa.schema([("id", pa.int64()), ("label", pa.string()), ("members", pa.list_(pa.struct([("text", pa.string()), ("count", pa.int64())]))), ("occurrences", pa.list_(OCCURRENCE)), ("segments", pa.list_(pa.int64()))])


def cluster_lines(ids: list[int], sizes: list[int], text: list[str], start: list[float], stop: list[float], confidence: list[float], segment: list[int]) -> Iterator[str]:
    """Clusters as JSON, a line each; those of ``sizes`` take their occurrences from the lists in turn. The least text is the label, segments ascend."""
    write = json.JSONEncoder(ensure_ascii=False).encode
    # most values occur more than once
    quoted, written = {w: write(w) for w in set(text)}, {x: repr(x) for x in {*start, *stop, *confidence}}
    each = [f'{{"start":{written[a]},"stop":{written[b]},"text":{quoted[w]},"confidence":{written[c]},"segment":{s}}}' for a, b, w, c, s in zip(start, stop, text, confidence, segment, strict=True)]
    low = 0
    for number, n in zip(ids, sizes, strict=True):
        high = low + n
        label, segments = quoted[min(text[low:high])], ",".join(map(str, sorted(set(segment[low:high]))))
        yield f'{{"id":{number},"label":{label},"members":[{{"text":{label},"count":{n}}}],"occurrences":[{",".join(each[low:high])}],"segments":[{segments}]}}'
        low = high


def clusters_of(lines: list[str]) -> pa.Table:
    """``cluster_of`` for many lines at once, outside Spark."""
    if not lines:
        return CLUSTERS.empty_table()
    held = "\n".join(lines).encode()
    # a block ends with a line, so the longest line has to fit
    read = pj.ReadOptions(use_threads=False, block_size=len(held) + 1)
    return pj.read_json(pa.BufferReader(held), read, pj.ParseOptions(explicit_schema=CLUSTERS, unexpected_field_behavior="ignore")).combine_chunks()


def cluster_figures(clusters: pa.Table) -> dict[str, pa.Array]:
    """id, label, members (their first count), mean confidence, first start, last stop and number of segments of each cluster with occurrences."""
    column = lambda name: clusters.column(name).combine_chunks()
    occurrences, members = column("occurrences"), column("members")
    sizes = occurrences.value_lengths().to_numpy()
    flat, low = occurrences.flatten(), np.cumsum(sizes) - sizes
    of = lambda name: flat.field(name).to_numpy()
    mean = np.bincount(np.repeat(np.arange(len(sizes)), sizes), of("confidence"), len(sizes)) / sizes
    return {
        "id": column("id"), "label": column("label"), "members": pc.list_element(members, 0).field("count"), "mean": pa.array(mean),
        "first": pa.array(np.minimum.reduceat(of("start"), low)), "last": pa.array(np.maximum.reduceat(of("stop"), low)), "segments": column("segments").value_lengths().cast(pa.int64()),
    }


def cluster_of(json: Column) -> Column:
    """A cluster from JSON; missing segments are none, an occurrence without segment has -1. Null where the text is no JSON."""
    c = F.from_json(json, CLUSTER)
    occurrences = F.transform(F.coalesce(c["occurrences"], F.array().cast("array<struct<start:double,stop:double,text:string,confidence:double,segment:bigint>>")), lambda o: o.withField("segment", F.coalesce(o["segment"], F.lit(-1).cast("bigint"))))
    return F.when(c["id"].isNotNull(), c.withField("occurrences", occurrences).withField("segments", F.coalesce(c["segments"], F.array().cast("array<bigint>"))))


def region_of(json: Column) -> Column:
    """An offset region from JSON."""
    return F.from_json(json, REGION)


def interval_of(json: Column) -> Column:
    """A damping interval from JSON."""
    return F.from_json(json, INTERVAL)


def line_of(json: Column) -> Column:
    """A timed line from JSON; flags that are missing are false."""
    c = F.from_json(json, LINE)
    for flag in ("crowd", "background", "disabled"):
        c = c.withField(flag, F.coalesce(c[flag], F.lit(False)))
    return c


def line_json(line: Column) -> Column:
    """A line as JSON with every field written, nulls too; a transient field ``made`` is not."""
    fields = [x.split(":")[0] for x in ("text:", "start:", "stop:", "quality:", "crowd:", "background:", "disabled:", "pieces:")]
    return F.to_json(F.struct(*(line[x].alias(x) for x in fields)), {"ignoreNullFields": "false"})


def step_of(steps: Column, name: str) -> Column:
    """The step's value, or null."""
    return F.try_element_at(steps, F.lit(name))


def with_step(steps: Column, name: str, value: Column) -> Column:
    """The steps with one set, replaced where it was there."""
    return F.map_concat(F.map_filter(steps, lambda k, _: k != name), F.create_map(F.lit(name), value))


def without_step(steps: Column, name: str) -> Column:
    """The steps without one."""
    return F.map_filter(steps, lambda k, _: k != name)


def renamed(steps: Column, names: dict[str, str]) -> Column:
    """The steps under new names; names that the table does not know stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(steps, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def moved(steps: Column, old: str, new: str) -> Column:
    """The steps with a path prefix replaced in every value that begins with it."""
    return F.transform_values(steps, lambda _, v: F.when(v.startswith(old), F.concat(F.lit(new), F.substring(v, len(old) + 1, 1 << 30))).otherwise(v))


def language_files(spark: SparkSession, folder: str) -> DataFrame:
    """Language data, a JSON file for each two-letter code; files that cannot be read are skipped."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("vowels array<string>, clusters array<string>").json(folder)
    code = F.regexp_extract(F.input_file_name(), r"/([A-Za-z]{2})\.json$", 1)
    return rows.withColumn("code", F.lower(code)).filter("code != '' and (vowels is not null or clusters is not null)")


def audio_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("wav", "flac", "mp3", "m4a", "ogg")) -> DataFrame:
    """For each stem the file with the first extension of the list; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    place = F.array_position(F.lit(list(extensions)), kind)
    known = files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "path", "bytes", place.alias("place")).filter("place > 0")
    return known.groupBy("stem").agg(F.min_by(F.struct("path", "bytes"), F.struct("place", "path")).alias("f")).select("stem", "f.path", "f.bytes")


def write_transcript(words: DataFrame, folder: str) -> None:
    """One transcript fanned out: words as CSV and as JSON, segments as JSON and as text, a line each in order.

    ``words`` has segment, pos, word, start, stop and confidence. Part files are in order of their segments.
    """
    every = F.array_sort(F.collect_list(F.struct("pos", "word", "start", "stop", "confidence")))
    segments = words.groupBy("segment").agg(every.alias("words"))
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    segments = segments.select("segment", text.alias("text"), F.array_min(F.transform("words", lambda w: w["start"])).alias("start"), F.array_max(F.transform("words", lambda w: w["stop"])).alias("stop"), "words")
    ordered = segments.repartitionByRange("segment").sortWithinPartitions("segment")
    rows = words.repartitionByRange("segment").sortWithinPartitions("segment", "pos")
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/words_csv")
    rows.write.mode("overwrite").json(f"{folder}/words_json")
    ordered.write.mode("overwrite").json(f"{folder}/segments")
    ordered.select("text").write.mode("overwrite").text(f"{folder}/transcript")


def save_timing(lines: DataFrame, folder: str, version: str) -> None:
    """The lines under their version; what was there goes to the history first, under the version it had."""
    spark, jvm = lines.sparkSession, lines.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/timing")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        spark.read.json(f"{folder}/timing").write.mode("append").json(f"{folder}/history")
    lines.withColumn("version", F.lit(version)).write.mode("overwrite").json(f"{folder}/timing")
