import random

import pytest
from pyspark.sql import functions as F

from cantrix.functions import text as T
from cantrix.operators import align, graph, intervals, nearest, sequence, stats


def spans(spark, rows):
    return spark.createDataFrame(rows, "track int, start double, stop double")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merge_keeps_running_end(spark):
    s = spans(spark, [(1, 10.0, 10.4), (1, 10.42, 10.8), (1, 50.0, 50.5), (2, 0.0, 9.0), (2, 1.0, 2.0), (2, 8.0, 10.0)])
    assert got(intervals.merged(s, ["track"], 0.05), "track", "start", "stop") == [(1, 10.0, 10.8), (1, 50.0, 50.5), (2, 0.0, 10.0)]


def test_pause_looks_at_previous_row(spark):
    s = spans(spark, [(1, 0.0, 9.0), (1, 1.0, 2.0), (1, 8.0, 10.0)])
    assert [r["part"] for r in intervals.grouped_by_pause(s, ["track"], 0.6, ["start"]).orderBy("start").collect()] == [1, 1, 2]


def test_coverage_and_difference(spark):
    w = spans(spark, [(1, 0.0, 10.0), (2, 0.0, 1.0)])
    s = spans(spark, [(1, 2.0, 4.0), (1, 3.0, 5.0), (1, 9.0, 12.0)])
    assert got(intervals.covered(w, s, ["track"]), "track", "covered", "uncovered") == [(1, 4.0, 6.0), (2, 0.0, 1.0)]
    assert got(intervals.only_in(w, s, ["track"]), "track", "start", "stop") == [(1, 0.0, 2.0), (1, 5.0, 9.0), (2, 0.0, 1.0)]


def test_projection(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((50.0, 150.0, 250.0, 100.0))], "track int, id int, t double")
    regions = spark.createDataFrame([(1, 0.0, 100.0, -0.5), (1, 100.0, 200.0, -1.0)], "track int, start double, stop double, offset double")
    out = nearest.projected(rows, regions, ["track"], "t", "id")
    assert [r["projected"] for r in out.orderBy("id").collect()] == [49.5, 149.0, 249.0, 99.25]
    none = nearest.projected(rows, regions.limit(0), ["track"], "t", "id")
    assert [r["projected"] for r in none.orderBy("id").collect()] == [50.0, 150.0, 250.0, 100.0]
    back = nearest.projected(out.select("track", "id", F.col("projected").alias("t")), regions, ["track"], "t", "id", reverse=True)
    assert [round(r["projected"], 6) for r in back.orderBy("id").collect()] == [50.0, 150.0, 250.0, 100.0]


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), i, rng.randint(0, 50)) for i in range(60)]
    marks = [(rng.randint(1, 2), rng.randint(0, 50)) for _ in range(20)]
    out = nearest.nearest(spark.createDataFrame(rows, "track int, id int, t int"), spark.createDataFrame(marks, "track int, at int"), ["track"], "t", "id")
    for r in out.collect():
        own = [m for t, m in marks if t == r["track"]]
        assert r["nearest"] == (min(own, key=lambda m: (abs(m - r["t"]), m)) if own else None)


def test_interpolation(spark):
    rows = [(1, 1, None, None), (1, 2, 10.0, 12.0), (1, 3, None, None), (1, 4, None, None), (1, 5, 20.0, 24.0), (1, 6, None, None), (2, 1, None, None)]
    out = sequence.interpolated(spark.createDataFrame(rows, "track int, n int, start double, stop double"), ["track"], "n").orderBy("track", "n").collect()
    assert [(r["start"], r["stop"]) for r in out] == [(6.0, 10.0), (10.0, 12.0), (12.0, 16.0), (16.0, 20.0), (20.0, 24.0), (24.0, 28.0), (None, None)]


def test_folds(spark):
    rng = random.Random(5)
    items = sorted((float(rng.randint(0, 90)), 0.0) for _ in range(40))
    items = [(s, s + rng.randint(1, 9)) for s, _ in items]
    df = spark.createDataFrame([(items,)], "x array<struct<start:double,stop:double>>")
    kept, last = [], None
    for s, e in items:
        if last is None or s >= last:
            kept.append((s, e))
            last = e
    row = df.select(sequence.non_overlapping(F.col("x")).alias("k"), sequence.monotonic(F.col("x"), 2.0).alias("m")).first()
    assert [tuple(r) for r in row["k"]] == kept
    ordered = [tuple(r) for r in row["m"]]
    assert all(e - s >= 2 for s, e in ordered) and all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def test_spread_picks(spark):
    df = spark.createDataFrame([([(5.0, 1.0), (9.0, 2.0), (1.0, 10.0), (9.0, 2.5)],)], "x array<struct<level:double,at:double>>")
    assert df.select(sequence.spread_picks(F.col("x"), 2.0).alias("k")).first()["k"] == [2.0, 10.0]


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    assert df.agg(stats.upper_median(F.col("x"))).first()[0] == 3.0
    assert df.limit(0).agg(stats.upper_median(F.col("x"))).first()[0] is None


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, child long")
    assert got(graph.closure(e, spark.createDataFrame([(2,)], "node long")), "node") == [(1,), (2,), (3,)]
    p = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41)], "a long, b long")
    assert {r["label"] for r in graph.components(p).collect()} == {0, 40}


#: By spelling, as before sound keys decided.
SPELLING = [(["kedeng", "er", "een"], ["kedeng", "ereen"], [(0, 0), (1, 1), (2, 1)]), ([], ["a"], [])]
#: By sound: a couple that merges, unlike words that stay apart, a number that is heard in English, a vocalise that no half resembles.
SOUND = [
    (["kedeng", "kedeng", "kilometers"], ["gedengedeng", "kilometers"], [(0, 0), (1, 0), (2, 1)]),
    (["kilometers", "spoor"], ["kilo", "meters", "spoor"], [(0, 0), (0, 1), (1, 2)]),
    (["koffie"], ["thee"], []),
    (["a"], [], []),
]


@pytest.mark.parametrize(("left", "right", "pairs"), SPELLING)
def test_align_by_spelling(left, right, pairs):
    assert [(i, j) for i, j, _ in align.align(left, right, align.levenshtein_similarity)] == pairs


@pytest.mark.parametrize(("left", "right", "pairs"), SOUND)
def test_align(left, right, pairs):
    assert [(i, j) for i, j, _ in align.align(left, right)] == pairs


def similarity(a, b):
    """One pair of sound keys, from the definition."""
    unit = lambda k: next((k[:n] for n in range(1, len(k) // 2 + 1) if (k[:n] * len(k))[: len(k)] == k), k)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = sorted((unit(a), unit(b)), key=len)
    return 0.95 if x == y else len(x) / len(y) if len(x) >= 3 and x in y else align.levenshtein_similarity(x, y)


def plain_align(left, right):
    """The alignment cell by cell, forwards from each reached cell; an equal score never replaces one."""
    n, m, s = len(left), len(right), similarity
    best, move = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            here, steps = best[i, j], []
            if i < n:
                steps.append((i + 1, j, here - 0.15, None))
            if j < m:
                steps.append((i, j + 1, here - 0.15, None))
            if i < n and j < m:
                x = s(left[i], right[j])
                steps.append((i + 1, j + 1, here + (x - 0.45), x))
            if i + 1 < n and j < m and max(s(left[i], right[j]), s(left[i + 1], right[j])) >= 0.3:
                x = s(left[i] + left[i + 1], right[j])
                steps.append((i + 2, j + 1, here + (x - 0.45) - 0.05, x))
            if i < n and j + 1 < m and max(s(left[i], right[j]), s(left[i], right[j + 1])) >= 0.3:
                x = s(left[i], right[j] + right[j + 1])
                steps.append((i + 1, j + 2, here + (x - 0.45) - 0.05, x))
            for p, q, value, x in steps:
                if value > best.get((p, q), float("-inf")):
                    best[p, q], move[p, q] = value, (i, j, x)
    out, at = [], (n, m)
    while at in move:
        i, j, x = move[at]
        if x is not None:
            out += [(p, q, x) for p in range(i, at[0]) for q in range(j, at[1])]
        at = (i, j)
    return sorted(out)


def test_align_against_plain_recurrence(spark):
    rng = random.Random(7)
    words = "kedeng kedengkedeng trein de het spoor kilometers la lala oe oeh koffie thee een er eren x".split()
    texts = [(rng.choices(words, k=rng.randint(0, 9)), rng.choices(words, k=rng.randint(0, 12))) for _ in range(90)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "key long, a array<string>, b array<string>")
    found = {i: [] for i in range(len(texts))}
    for r in align.aligned(df, "key", "a", "b").collect():
        found[r["key"]].append((r["left_pos"], r["right_pos"], r["similarity"]))
    for i, (a, b) in enumerate(texts):
        want = plain_align([T.sound_of(x) for x in a], [T.sound_of(x) for x in b])
        assert [x[:2] for x in sorted(found[i])] == [x[:2] for x in want]
        assert [x[2] for x in sorted(found[i])] == pytest.approx([x[2] for x in want])


def test_numbers_have_two_sounds(spark):
    df = spark.createDataFrame([(1, ["500", "meter"], ["five", "hundred", "meter"]), (2, ["500", "meter"], ["vijfhonderd", "meter"]), (3, None, ["a"])], "key long, a array<string>, b array<string>")
    got = {(r["key"], r["left_pos"], r["right_pos"]) for r in align.aligned(df, "key", "a", "b").collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 0), (2, 1, 1)}


def test_sound_of_equals_the_expression(spark):
    words = ["Kedeng", "gedengedeng", "schoen", "Ça", "xx", "exxit", "rauw", "500", "l'été", "", "Höhe", "ijs-je"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(T.sound_key(F.col("w")))
    assert [r[0] for r in df.collect()] == [T.sound_of(w) for w in words]


def test_text_ratio(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz")], "a string, b string")
    assert [r[0] for r in df.select(align.same_text(F.col("a"), F.col("b"))).collect()] == [True, False]
