"""Nested JSON, documents of steps, and files in folders."""

import json

from pyspark.sql import functions as F

from cantrix.sources import nested


def one(spark, text, of):
    return spark.createDataFrame([(text,)], "t string").select(of(F.col("t")).alias("x")).first()["x"]


def test_missing_fields(spark):
    c = one(spark, '{"id": 3, "label": "KEDENG", "occurrences": [{"start": 1.0, "stop": 2.0, "text": "kedeng", "confidence": 0.9}]}', nested.cluster_of)
    assert c["segments"] == [] and c["occurrences"][0]["segment"] == -1 and c["members"] is None
    assert one(spark, "no json", nested.cluster_of) is None
    line = one(spark, '{"text": "a", "crowd": true}', nested.line_of)
    assert (line["crowd"], line["background"], line["disabled"], line["start"]) == (True, False, False, None)


def test_line_json_writes_every_field(spark):
    text = one(spark, '{"text": "a", "pieces": [{"text": "a", "start": 0.5}]}', lambda t: nested.line_json(nested.line_of(t)))
    assert set(json.loads(text)) == {"text", "start", "stop", "quality", "crowd", "background", "disabled", "pieces"}
    assert json.loads(text)["pieces"][0]["start"] == 0.5


def test_steps(spark):
    df = spark.createDataFrame([({"a": "old/x", "b": "y"},), ({},), (None,)], "s map<string,string>")
    got = df.select(
        nested.step_of(F.col("s"), "a").alias("a"), nested.with_step(F.col("s"), "b", F.lit("z")).alias("set"), nested.without_step(F.col("s"), "a").alias("left"),
        nested.renamed(F.col("s"), {"a": "c"}).alias("named"), nested.moved(F.col("s"), "old/", "new/").alias("moved"),
    ).collect()
    assert tuple(got[0]) == ("old/x", {"a": "old/x", "b": "z"}, {"b": "y"}, {"c": "old/x", "b": "y"}, {"a": "new/x", "b": "y"})
    assert tuple(got[1]) == (None, {"b": "z"}, {}, {}, {})
    assert got[2]["a"] is None and got[2]["left"] is None


def test_folders(spark, tmp_path):
    langs = tmp_path / "langs"
    langs.mkdir()
    (langs / "nl.json").write_text('{"vowels": ["aa", "e"],\n "clusters": ["sch"]}')
    (langs / "xx.json").write_text("{broken")
    (langs / "notes.json").write_text('{"vowels": ["a"]}')
    got = nested.language_files(spark, str(langs)).collect()
    assert [(r["code"], r["vowels"], r["clusters"]) for r in got] == [("nl", ["aa", "e"], ["sch"])]
    songs = tmp_path / "songs"
    songs.mkdir()
    for name in ("one.mp3", "one.wav", "two.ogg", "three.txt"):
        (songs / name).write_bytes(b"x" * len(name))
    files = {r["stem"]: (r["path"].rsplit("/", 1)[1], r["bytes"]) for r in nested.audio_files(spark, str(songs)).collect()}
    assert files == {"one": ("one.wav", 7), "two": ("two.ogg", 7)}


def test_writers(spark, tmp_path):
    words = spark.createDataFrame([(1, 2, "b", 0.5, 0.9, 0.5), (1, 1, "a", 0.0, 0.4, 1.0), (0, 1, "z", 9.0, 9.5, None)], "segment int, pos int, word string, start double, stop double, confidence double")
    nested.write_transcript(words, str(tmp_path))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/transcript").collect()] == ["z", "a b"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/words_csv").count() == spark.read.json(f"{tmp_path}/words_json").count() == 3
    back = {r["segment"]: (r["text"], r["start"], r["stop"], len(r["words"])) for r in spark.read.json(f"{tmp_path}/segments").collect()}
    assert back == {0: ("z", 9.0, 9.5, 1), 1: ("a b", 0.0, 0.9, 2)}
    lines = spark.createDataFrame([("a", 1.0)], "text string, start double")
    nested.save_timing(lines, str(tmp_path), "0.1")
    nested.save_timing(lines.withColumn("start", F.lit(2.0)), str(tmp_path), "0.2")
    now, before = (spark.read.json(f"{tmp_path}/{x}").collect() for x in ("timing", "history"))
    assert [(r["start"], r["version"]) for r in now] == [(2.0, "0.2")] and [(r["start"], r["version"]) for r in before] == [(1.0, "0.1")]
