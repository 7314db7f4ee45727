"""Queries over whole tables, against brute force on small ones."""

import collections
import hashlib
import json
import re

import numpy as np
from pyspark.sql import functions as F
from test_operators import similarity

from cantrix.functions import text as T
from cantrix.plans import catalog, details, evaluation, texts, words  # noqa: F401

TEXTS = ["Kedeng kedeng de trein", "de trein rijdt", "Koffie, koffie-thee en thee", "de trein", "gedengedeng"]


def documents(spark, folder, n=45):
    rows = [(i, TEXTS[i % 5] + (f" alleen{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" if i % 2 else ""), "nl", "s", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return {r[0]: r[1].split() for r in rows}


def run(spark, name, folder):
    return [tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect()]


def norm(word):
    return word.lower().strip(",").strip("-")


def test_nth_marks(spark, tmp_path):
    want = []
    for i, words in documents(spark, tmp_path).items():
        seen = collections.Counter()
        for pos, w in enumerate(words, 1):
            seen[w.lower()] += 1
            want.append((i, pos, w.lower(), seen[w.lower()]))
    assert sorted(run(spark, "nth_marks", tmp_path)) == sorted(want)


def test_frequent_grams(spark, tmp_path):
    n = collections.Counter()
    for words in documents(spark, tmp_path).values():
        w = [norm(x) for x in words]
        n.update((" ".join(w[i : i + k]), k) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    assert sorted(run(spark, "frequent_grams", tmp_path)) == sorted((*g, c) for g, c in n.items() if c >= 3)


def test_similar_keys(spark, tmp_path):
    """Words of single documents count whatever the document's id."""
    rows = [(i, w, "nl", "s", 1) for i, w in enumerate(["de", "koffie", "thee", "kedeng", "koffies", "gedengedeng"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sounds = spark.createDataFrame([(r[1],) for r in rows], "w string").select(T.sound_key("w")).collect()
    got = {(a, b): s for a, b, s in run(spark, "similar_keys", tmp_path)}
    for key in {r[0] for r in sounds[1:4] + sounds[5:]}:
        assert got[key, key] == 1.0


def test_word_forms(spark, tmp_path):
    n = collections.Counter(w for words in documents(spark, tmp_path).values() for w in words)
    got = {r[0]: r for r in run(spark, "word_forms", tmp_path)}
    assert {w: r[1] for w, r in got.items()} == n
    assert all(r[4] == hashlib.sha1(w.encode()).hexdigest()[:16] for w, r in got.items())


def test_linked_groups(spark, tmp_path):
    customers = [1, 2, 4, 6, 8, 9, 9, 13]
    spark.createDataFrame([(i, c) for i, c in enumerate(customers, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(run(spark, "linked_groups", tmp_path)) == sorted({(x, c // 3 * 3) for c in customers for x in (c, c // 3 * 3)})


def test_cosine_search(spark, tmp_path, monkeypatch):
    from cantrix.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 16)
    x = np.random.default_rng(3).normal(size=(90, 8)).astype(np.float32)
    x[50:65] = x[40]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = []
    for q in range(0, 90, 20):
        c = np.round(u @ u[q], 6)
        want += [(q, i, c[i]) for i in np.lexsort((np.arange(90), -c)) if i != q][:10]
    got = sorted(run(spark, "cosine_search", tmp_path))
    assert [r[:2] for r in got] == sorted(r[:2] for r in want)
    assert np.allclose([r[2] for r in got], [r[2] for r in sorted(want)], atol=2e-6)


def test_sound_clusters(spark, tmp_path):
    docs = documents(spark, tmp_path)
    heard = spark.createDataFrame([(i, norm(w)) for i, words in docs.items() for w in words], "i long, w string").select("i", T.sound_key("w")).collect()
    want = []
    for i in docs:
        n, chosen = collections.Counter(s for k, s in heard if k == i and s), []
        for sound in sorted(n, key=lambda s: (-n[s], s)):
            lead = next((c for c in chosen if similarity(c, sound) >= 0.65), sound)
            if lead == sound:
                chosen.append(sound)
            want.append((i, sound, n[sound], lead))
    assert sorted(run(spark, "sound_clusters", tmp_path)) == sorted(want)


def test_frequent_grams_in_small_chunks(spark, tmp_path, monkeypatch):
    """Counts of many chunks are added, longer runs are looked for only where shorter ones are frequent, and no word is kept in a window."""
    from cantrix.operators import grams

    monkeypatch.setattr(grams, "CHUNK", 7)
    rows = [(i, t) for i, t in enumerate(["a b - c  d e", "a b\tc d e a b", None, "", " a B - c d e", "x-y É'", "A b - c d, e a b x-y é", "b - c d e", "x-y é"])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    n = collections.Counter()
    for _, t in rows:
        w = [x.lower().strip(",'-") for x in (t or "").split()]
        n.update((" ".join(w[i : i + k]), k) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    df = catalog.queries()["frequent_grams"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted((*g, c) for g, c in n.items() if c >= 3)
    assert "Window" not in df._jdf.queryExecution().toString()


def test_repaired_dips_at_exactly_half(spark, tmp_path):
    """Levels whose blend is half of the loudest in whole hundredths are no dip, in whatever order they are added."""
    import datetime
    import itertools

    from cantrix.plans import frames  # noqa: F401

    rows, i = [], 0
    for track, order in enumerate(itertools.permutations([("error", 16.85), ("view", 15.55), ("click", 21.46), ("view", 61.71), ("purchase", 0.32)])):
        for n, (label, value) in enumerate(order):
            rows.append((i := i + 1, datetime.datetime(2024, 1, 1, n), track, label, value))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = run(spark, "repaired_dips", tmp_path)
    assert len(got) == 120 and {r[2:] for r in got} == {("view", 19.315, False)}


def test_standardized_runs_in_proportion(spark):
    """The mean and the spread are made once for a vector, not for each of its elements."""
    import time

    from cantrix.functions import vector as V

    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: x.cast("double")).alias("e"))
    at = time.time()
    got = v.select(F.get(V.standardized(F.col("e")), F.lit(0))).first()[0]
    assert time.time() - at < 30 and abs(got + np.sqrt(3 * 1999 / 2001)) < 1e-9


def test_sound_clusters_of_odd_texts(spark, tmp_path):
    """Null and empty texts, shared ids, long keys and letters of many scripts; the words of a document stay in its row."""
    long = "".join("abk"[k * k % 7 % 3] + "elmo"[k % 4] for k in range(30))
    many = "".join(chr(0x4E00 + 3 * k) for k in range(150))
    rows = [(1, f"Xx-x x {long} {long}l l{long[:50]}s Été été"), (1, None), (2, None), (3, ""), (4, f"{many} {many[:140]}l {many[:60]} 12 hr kx"), (None, "de the"), (1, "ete de\x0bde\x00n\xa0n tetete"), (5, "banana bananas nana bana")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    heard = [(i, w) for i, t in rows for w in re.split(r"[ \x0b]+", t or "") if w]
    heard = spark.createDataFrame(heard, "i long, w string").select("i", T.sound_key(T.normalize_word(F.col("w")))).collect()
    want = []
    for i in {r[0] for r in rows}:
        n, chosen = collections.Counter(s for k, s in heard if k == i and s), []
        for sound in sorted(n, key=lambda s: (-n[s], s)):
            lead = next((c for c in chosen if similarity(c, sound) >= 0.65), sound)
            if lead == sound:
                chosen.append(sound)
            want.append((i, sound, n[sound], lead))
    df = catalog.queries()["sound_clusters"](spark, str(tmp_path))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    assert "Generate" not in df._jdf.queryExecution().toString()


def test_leaders_of_many_keys():
    """A text of 2000 keys in parts of the table of letters in common, against pairs one by one."""
    from cantrix.operators import align

    r = np.random.default_rng(5)
    sounds = list(dict.fromkeys("".join(r.choice(list("abketilo"), r.integers(1, 9))) for _ in range(2000)))
    pairs = [(k, e) for k in range(len(sounds)) for e in range(k)]
    like = dict(zip(pairs, align.similarities([sounds[k] for k, _ in pairs], [sounds[e] for _, e in pairs]) >= 0.65, strict=True))
    chosen, want = [], []
    for k, sound in enumerate(sounds):
        lead = next((e for e in chosen if like[k, e]), k)
        chosen += [k] * (lead == k)
        want.append(sounds[lead])
    assert align.leader_of([[], sounds, sounds[:3]], 0.65) == [[], want, want[:3]]


def test_alignment_of_odd_keys():
    """Empty, long and foldable keys, whose couples are left out only where they cannot be taken."""
    import random

    from test_operators import plain_align

    from cantrix.operators import align

    r = random.Random(11)
    vocabulary = ["", "a", "ka", "kaka", "kakak", "lo", "tikol", "tiko", "abket" * 7 + "l", "abket" * 8 + "lo", "".join("abkl"[k * k % 7 % 4] for k in range(40)), *(chr(0x4E00 + k) + "tik" for k in range(140))]
    texts = [([r.choice(vocabulary[: r.choice([7, 11, 151])]) for _ in range(r.randint(0, 9))], [r.choice(vocabulary) for _ in range(r.randint(0, 9))]) for _ in range(60)]
    found = align.align_keys([([[x] for x in a], b) for a, b in [*texts, ([], vocabulary)]])
    for got, (a, b) in zip(found, texts, strict=False):
        assert got == [(i, j, float(x)) for i, j, x in plain_align(a, b)]


def test_alignment_runs_along_diagonals():
    """A table of 360,000 cells is not computed cell by cell."""
    import time

    from cantrix.operators import align

    r = np.random.default_rng(2)
    left = ["".join(r.choice(list("abketilo"), 6)) for _ in range(600)]
    at = time.time()
    found = align.align_keys([([[x] for x in left], left[1:])])[0]
    assert time.time() - at < 8 and [(k, k - 1, 1.0) for k in range(1, 600)] == found


def test_clusters_through_json_of_odd_texts(spark, tmp_path, monkeypatch):
    """Words that JSON has to escape, null and empty texts, shared ids; a cluster is written once and no word is shuffled."""
    from cantrix.plans import nested

    monkeypatch.setattr(nested, "CHUNK", 40)
    rows = [(1, 'say "hi" a\\b \x01c d e \U0001f600 {"id":1} /n é'), (1, "two texts one"), (2, None), (3, ""), (4, " \t\n"), (None, "de the de"), (5, "a b\x00 c " * 30), (6, "x" * 5000 + " y")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = collections.defaultdict(list)
    for i, text in rows:
        for pos, w in enumerate((w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w), 1):
            n = len(w)
            start = pos * 400 + n * 37 % 150
            held[i, n].append((w, start / 1000, (start + 100 + 60 * n) / 1000, (pos - 1) // 8))
    want = [(i, n, min(h)[0], len(h), n * 7 % 10 / 10, min(x[1] for x in h), max(x[2] for x in h), len({x[3] for x in h})) for (i, n), h in held.items()]
    df = catalog.queries()["clusters_through_json"](spark, str(tmp_path))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    plan = df._jdf.queryExecution().toString()
    assert "Generate" not in plan and "from_json" not in plan


def test_clusters_are_read_as_written():
    """What is missing is null or none, what is not asked for is left out."""
    from cantrix.sources import nested

    lines = list(nested.cluster_lines([3, 5], [2, 1], ['b"c', "a\\b", "hello"], [0.4, 1.25, 2.0], [0.7, 1.5, 2.4], [0.1, 0.3, 0.5], [4, 0, 7]))
    assert [json.loads(x)["segments"] for x in lines] == [[0, 4], [7]]
    table = nested.clusters_of([*lines, '{"id":9,"other":{"x":1},"occurrences":[]}'])
    assert [{k: v for k, v in r.items() if v is not None} for r in table.to_pylist()] == [*map(json.loads, lines), {"id": 9, "occurrences": []}]
    figures = {k: v.to_pylist() for k, v in nested.cluster_figures(table.slice(0, 2)).items()}
    assert figures == {"id": [3, 5], "label": ["a\\b", "hello"], "members": [2, 1], "mean": [0.2, 0.5], "first": [0.4, 2.0], "last": [1.5, 2.4], "segments": [2, 1]}
