import datetime as dt

from pyspark.sql import functions as F

from cantrix.sources import transcripts
from cantrix.streaming import sessions


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_and_publishing(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, i, at + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 100, 105))] + [(1, 0, at)]
    spark.createDataFrame(rows, "user int, id int, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = sessions.file_stream(spark, str(tmp_path / "in"), "user int, id int, at timestamp")
    out = drain(sessions.sessions(stream, "user", "at", "30 seconds", "0 seconds"), "s", "complete")
    assert sorted(r["n"] for r in out.collect()) == [2, 3]
    stream = sessions.file_stream(spark, str(tmp_path / "in"), "user int, id int, at timestamp")
    assert drain(sessions.published(stream, "id", "at"), "p", "append").count() == 4


def test_leases(spark):
    at = dt.datetime(2024, 1, 1)
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "job int, worker string")
    beats = spark.createDataFrame([("a", at, "busy"), ("b", at - dt.timedelta(hours=1), "idle")], "worker string, at timestamp, status string")
    assert {r["job"] for r in sessions.stale_claims(claims, beats, at, 1800).collect()} == {2, 3}
    assert [r["worker"] for r in sessions.active_workers(beats, 120).collect()] == ["a"]


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"index": 0, "text": "a b", "start": 0.0, "end": 1.0, "words": [{"text": "a", "start": 0.0, "end": 0.5, "confidence": 0.9}]}]')
    s = transcripts.read_segments(spark, str(tmp_path / "s.json"))
    assert s.first()["origin"] == "" and transcripts.segment_words(s).first()["text"] == "a"
    for name, body in (("a.json", '[{"line": 1, "text": "x"}]'), ("b.json", '{"lines": [{"line": 1, "text": "x"}]}')):
        (tmp_path / name).write_text(body)
        assert transcripts.read_timing(spark, str(tmp_path / name)).first()["text"] == "x"
    transcripts.write_words_csv(transcripts.segment_words(s), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).filter(F.col("value").contains(";")).count() == 2


def test_reference_text(spark):
    text = ["# note", "one two", "[crowd]hey[/crowd]", "", "[bg]", "ooh", "[/bg]", "three"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "song int, n int, line string")
    out = transcripts.parse_lines(df, ["song"]).orderBy("n").collect()
    assert [(r["line"], r["block"], r["crowd"], r["bg"]) for r in out] == [("one two", 1, False, False), ("hey", 1, True, False), ("ooh", 2, False, True), ("three", 2, False, False)]
