"""Whole queries on small tables whose results are known."""

import numpy as np


def test_line_dedup_small_hosts(spark, tmp_path):
    """The ratio decides for hosts of every size; a line on one page is never boilerplate."""
    import corpus_pipeline
    from cantrix.llm import queries

    pages = [("a", 6, {0, 1}), ("b", 60, {3, 4, 5}), ("c", 61, {3, 4, 5, 6}), ("d", 1, {0}), ("e", 9, set(range(9)))]
    rows, want = [], {}
    for host, n, menu in pages:
        for i in range(n):
            text = f"own {host} {i}" + ("\nmenu" if i in menu else "")
            want[len(rows)] = f"own {host} {i}" if len(menu) > max(1, 0.05 * n) else text
            rows.append((len(rows), text, "en", host, len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == want


def test_neighbours_recall():
    """Recall at sizes where the least number of visited vectors does not hide the share."""
    from cantrix.llm.neighbours import Setting, forest, search

    for n, seed in ((5000, 0), (7000, 0), (10000, 1)):
        x = np.random.default_rng(seed).normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        setting = Setting()
        trees = forest(x, setting)
        at = [t.route(x) for t in trees]
        hits, queries = 0, range(0, n, 100)
        for q in queries:
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            seen = np.zeros(n, bool)
            for t, leaf in search(trees, x[q], max(setting.visit, int(setting.share * n))):
                seen |= at[t] == leaf
            hits += int(seen[np.argsort(d)[:10]].sum())
        assert hits / (10 * len(queries)) >= 0.93
