"""Joins, packing, mixing, neighbours and the pipeline against brute force."""

import collections
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cantrix.llm import jaccard, neighbours
from cantrix.llm.components import components
from cantrix.llm.mixing import mix
from cantrix.llm.neighbours import nearest
from cantrix.llm.packing import best_fit_decreasing, pack

SCHEMA = "doc_id long, text string, source string, digest string, length string, size string"


def copies(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d e f"]
    passage = rng.choices(words, k=60)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 and len(texts) > 8:
            w = (rng.choice(texts[6:]) or "").split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randint(3, 120)) + passage * (kind > 0.8)
        texts.append(" ".join(w))
    return texts + texts[:4]


def brute(texts, ids):
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: (len(sets[i]), least[find(i)]) for i, k in enumerate(ids)}


@pytest.mark.parametrize(("limit", "block"), [(64, 128), (3, 4)])
def test_jaccard(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LIST", limit)
    monkeypatch.setattr(jaccard, "PIVOTS", 1 if limit < 64 else 12)
    texts = copies(limit)
    ids = random.Random(1).sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "s", "x", "x", "x") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(texts, ids)


def joined(spark, texts, partitions=1):
    docs = spark.createDataFrame([(i, t, "s", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA).coalesce(partitions)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}


#: Two words that collide under every polynomial modulo 2**64.
TWINS = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]


@pytest.mark.parametrize("texts", [[], [None, None], ["", None, "a b c", "a b c", "A  b c", "d"], ["a b c", "one two three four five six"], [f"{x} and four words more here" for x in TWINS], TWINS])
def test_jaccard_small_tables(spark, texts):
    assert joined(spark, texts) == brute(texts, range(len(texts)))


def test_jaccard_copies_in_one_partition(spark):
    one = " ".join(f"w{i}" for i in range(60))
    assert joined(spark, [one] * 5000 + ["x " + one, one + " é " * 9000]) == dict.fromkeys(range(5000), (56, 0)) | {5000: (57, 0), 5001: (61, 0)}


def test_jaccard_shared_passages_make_no_pairs(spark, monkeypatch):
    """Documents with 170 of 200 words in common do not link, and their long lists are left by all of them."""
    passage = [f"p{i}" for i in range(170)]
    texts = [" ".join([f"u{d}x{i}" for i in range(30)] + passage) for d in range(300)]
    texts += [" ".join([f"q{i}" for i in range(170)] + [f"v{d}"]) for d in range(80)]
    seen = []
    kept = jaccard.rest_tasks
    monkeypatch.setattr(jaccard, "rest_tasks", lambda met, links: seen.append({r["v"] for r in met.collect()}) or kept(met, links))
    got = joined(spark, texts, 2)
    assert all(got[i] == (196, i) for i in range(300)) and all(got[i] == (167, 300) for i in range(300, 380))
    assert len(seen[0]) < 100


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(30)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[start] == min(seen)


def test_best_fit_is_best_fit():
    rng = random.Random(3)
    lengths = [rng.randint(1, 63) for _ in range(500)]
    runs, n = best_fit_decreasing(collections.Counter(lengths), 64)
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= x
        else:
            room.append(64 - x)
    assert n == len(room)
    used = collections.defaultdict(list)
    for length, first, end, sequence, offset in runs:
        for k in range(end - first):
            used[sequence + k].append((offset, length))
    assert sorted(x for v in used.values() for _, x in v) == sorted(lengths)
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64


def test_pack(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [None, "", "a <|endoftext|> b"] + [" ".join(rng.choices(["the", "zqx", "words"], k=rng.choice([5, 60, 700, 3000]))) for _ in range(40)]
    texts += texts[3:6]
    ids = [*range(len(texts) - 3), 3, 4, 5]
    docs = spark.createDataFrame([(i, t, "s", "x", "x", "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    rows = pack(docs).collect()
    held = collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(tokens), 1024):
            part = tokens[at : at + 1024]
            held[i, at, len(part), zlib.crc32(part.tobytes()), len(tokens)] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == held
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 50, 400, rng.randint(1, 900)])), rng.choice(["a", "b", "b", "b", "b", None, "é"]), "x", "x", "x") for i in range(1500)] + [(9007, None, "a", "x", "x", "x")]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, left, total = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    taken, source = collections.Counter(), {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.01)
    key = lambda rs: sorted((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(mix(docs.repartition(7)).collect()) == key(got)
    assert mix(docs.limit(0)).count() == 0


def test_nearest_rows_with_one_id(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 2.0], 1), (1, [3.0, 2.0], 1), (100, [1.0, 2.0], 1), (100, [9.0, 9.0], 1), (3, [3.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"], r["rank"]].append((r["vec_id"], round(r["score"], 6)))
    assert [got[0, k] for k in range(1, 6)] == [[(100, 0.0)], [(1, 1.0)], [(1, 2.0)], [(3, 2.0)], [(100, round(113**0.5, 6))]]
    assert sorted(got[100, 1]) == [(0, 0.0), (1, round(85**0.5, 6))]
    assert nearest(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


@pytest.mark.parametrize(("dims", "block"), [(24, 4096), (24, 100)])
def test_nearest_recall(spark, monkeypatch, dims, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = np.random.default_rng(dims).normal(size=(7000, dims))
    df = spark.createDataFrame([(i, v.tolist(), "clash", "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, slot string, x string")
    got = collections.defaultdict(set)
    for r in nearest(df, every=500).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 14 and hits >= 0.9 * 140


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(600, None, 1), (700, [0.0] * 16, 1), (800, [float("nan")] * 16, 1), (900, [None] * 16, 1), (None, x[1].tolist(), 1)]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(order) & {v for v, _ in found})
        assert len(found) == 10
        for v, s in found:
            assert s == pytest.approx(d[v], abs=1e-12)
        if q in (0, 100):
            assert [v for v, _ in found] == order
    assert hits >= 57
    assert nearest(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        before = {r["doc_id"]: r for r in docs.collect()}
        assert {r[0] for r in rows} <= set(before)
        if name == "jaccard_join":
            want = brute([r["text"] for r in before.values()], list(before))
            assert sorted(r[0] for r in rows) == sorted(i for i in before if want[i][1] == i)
        docs = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert collections.Counter(r["doc_id"] for r in last.filter("start = 0").collect()) == collections.Counter(r["doc_id"] for r in docs.collect())


def test_near_duplicates_are_rows(spark):
    """One row of each group stays, whatever its doc_id: repeated, null, or shared by unlinked texts."""
    import corpus_pipeline

    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, one, "en", "s", 1), (7, two, "en", "s", 1), (7, two, "en", "s", 1), (3, one + " more", "en", "t", 2), (None, two + " x", "en", "s", 1), (None, "other words", None, None, None), (None, "other words", None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert collections.Counter(got) == collections.Counter([rows[3], rows[1], rows[5], rows[7], rows[8], rows[9]])


def test_stages_bound_what_is_held_of_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from cantrix.llm.arrow import BATCHES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "bytes"])

    texts = spark.range(6000, numPartitions=1).selectExpr("id doc_id", "repeat(concat(id, ' x '), 500) text", "'en' lang", "'s' source", "1L n_chars")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.dedup_lines, corpus_pipeline.pack_windows):
        for name, (default, _) in BATCHES.items():
            spark.conf.set(name, default)
        stage(spark, docs, str(tmp_path))
        got = docs.select("text").mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 6000 and max(r["bytes"] for r in got) < 5 << 20
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"
    for name, (default, _) in BATCHES.items():
        spark.conf.set(name, default)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert all(spark.conf.get(name) == default for name, (default, _) in BATCHES.items())
    # an own setting of the session stays
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    corpus_pipeline.dedup_lines(spark, docs, "")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    for name in BATCHES:
        spark.conf.unset(name)


def test_stages_hold_no_column_chunk_outside_the_heap(spark, tmp_path):
    """A column chunk of 40 MB is read in pieces, and what a stage writes has short row groups and pages."""
    import pyarrow.parquet as pq

    import corpus_pipeline
    from cantrix.llm.arrow import BATCHES, small_batches

    pool = getattr(getattr(spark._jvm.org.apache.spark.metrics, "DirectPoolMemory$"), "MODULE$")
    rng = np.random.default_rng(5)
    texts = [rng.bytes(10_000).hex() for _ in range(2000)]
    table = pa.table({"doc_id": range(2000), "text": texts, "lang": ["en"] * 2000, "source": ["s"] * 2000, "n_chars": [20_000] * 2000})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=2000, use_dictionary=False, compression="none")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = pool.getMetricValues(None)[0]
    corpus_pipeline.dedup_lines(spark, docs, "").write.parquet(f"{tmp_path}/out")
    assert pool.getMetricValues(None)[0] - before < 16 << 20
    assert sorted(pq.read_table(tmp_path / "out", columns=["text"])["text"].to_pylist()) == sorted(texts)
    groups = [m.row_group(i).total_byte_size for f in (tmp_path / "out").glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert max(groups) < 20 << 20
    for name in BATCHES:
        spark.conf.unset(name)
    # settings that were not made are not made afterwards, and one of Hadoop's is kept
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "33554432")
    with small_batches(spark):
        assert spark.conf.get("parquet.page.size") == str(1 << 18)
        assert spark.conf.get("parquet.block.size", None) is None
    assert all(spark.conf.get(name, None) is None for name in BATCHES if name.startswith("parquet."))
    hadoop.unset("parquet.block.size")
