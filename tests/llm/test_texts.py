"""Text operators against brute force, on made-up texts and on edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cantrix.llm import bpe, licenses, textbuf
from cantrix.llm import toxicity as toxic
from cantrix.llm.languages import Setting, languages, learn
from cantrix.llm.line_dedup import line_dedup
from cantrix.llm.licenses import license_scan
from cantrix.llm.quality import quality_rules
from cantrix.llm.textbuf import chunks
from cantrix.llm.token_counts import token_counts
from cantrix.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, n_words string, score string, lines_dropped string"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = "the of and an er in la le de un idiot people".split()


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "é", "#", "漢"]) for _ in range(rng.choice([0, 3, 12, 60, 300]))]
        if rng.random() < 0.3:
            words = words + words[: rng.randint(0, 40)]
        out.append(rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "  ", "\n", "\t", ".\n\n"]) for w in words))
    return [None, "", "   ", "\n\n", "a", "x" * 50_000, "w " * 20_000, *out, *out[:5]]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus(1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab 's\n\t1!é漢٣　\xa0\x85<|>")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_ids_are_those_of_the_library(some):
    some = [*some, "<|endoftext|>".join(some)]
    (t,) = chunks(pa.array(some), 1 << 30)
    want = [LIBRARY.encode(x, add_special_tokens=False).ids for x in some]
    assert [x.tolist() for x in bpe.shared().ids(t)] == want
    assert bpe.shared().count(t).tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=12))
def test_spans_of_one_fingerprint_are_told_apart(some):
    data, ends = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    kept = textbuf._spans_hash
    for of in (kept, lambda value, first, *_: np.zeros(len(first), np.uint64)):
        textbuf._spans_hash = of
        try:
            number, pick = textbuf.distinct(data, ends[:-1], ends[1:])
        finally:
            textbuf._spans_hash = kept
        assert [some[pick[k]] for k in number] == some
        assert len(pick) == len(set(some)) and all(some.index(some[k]) == k for k in pick)


def test_words_that_collide_in_polynomials(spark):
    """The sequence of Thue and Morse and its complement have one value in every polynomial modulo 2**64."""
    one, two = ("".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1))
    some = [one + " x", two + " x", one + "\n" + two + "\n" + one, f"{one} {two}"]
    rows = table(spark, some)
    assert [r["n_dup_lines"] for r in quality_rules(rows).orderBy("doc_id").collect()] == [0, 0, 1, 0]
    assert [r["n_tokens"] for r in token_counts(rows).orderBy("doc_id").collect()] == [len(LIBRARY.encode(x).ids) for x in some]


def test_token_counts(spark, texts):
    got = {r["doc_id"]: r for r in token_counts(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    held = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if held[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def share_of_repeats(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    held = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {k for i in range(len(w) - n + 1) if held[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
    return sum(len(w[k]) for k in inside) / max(1, sum(map(len, w)))


def test_quality(spark, texts):
    got = {r["doc_id"]: r for r in quality_rules(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], base(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if len(t or "") < 5000:
            for n in (5, 10):
                assert r[f"dup_{n}gram_share"] == pytest.approx(share_of_repeats(t, n))


def test_license_base(spark):
    some = [None, "", "MIT License", "the mit\nlicense, Apache-License; CC BY-NC 4.0", "mit licenses", "cc by cc by", "GNU General Public License é license", "Licensed under the Apache License, Version 2.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"]
    got = {r["doc_id"]: r for r in license_scan(table(spark, some)).collect()}
    for i, text in enumerate(some):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[8]["labels"] == "cc-by" and got[8]["score"] == 1.0 and got[8]["span_first"] == 0


def test_matching_statistics():
    rng = random.Random(2)
    templates = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(5)]
    a = licenses.Automaton(templates)
    text = [rng.randint(0, 4) for _ in range(300)]
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (n, state) in enumerate(a.statistics(text)):
        want = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in inside))
        assert n == want
        if n:
            run = text[i + 1 - n : i + 1]
            places = {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == run}
            assert {(t, e) for t, ends in a.ends[state].items() for e in ends} == places


def test_languages(spark):
    rng = random.Random(4)
    sides = {"en": "the thing and wonder with shall".split(), "fr": "le chose et merveille avec déjà".split()}
    rows = [(i, " ".join(rng.choices(sides[x], k=30)), x, "s", 1, "", "", "", "") for i in range(80) for x in [rng.choice(["en", "fr"])]]
    rows += [(100, None, "en", "s", 1, "", "", "", ""), (101, "12 !!", "en", "s", 1, "", "", "", ""), (102, "", None, "s", 1, "", "", "", "")]
    got = {r["doc_id"]: r for r in languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows[:80]:
        assert got[r[0]]["lang_pred"] == r[2] and 0.5 < got[r[0]]["score"] <= 1
        assert got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))


def test_toxicity_learns_a_pair(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = rng.choices("alpha beta gamma delta".split(), k=12) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1, "", "", "", ""))
        labels.append((i, 1, int(a and b)))
    rows.append((5000, None, "en", "s", 1, "", "", "", ""))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs, marks).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.97
    assert 0 <= got[5000]["score"] <= 1
    assert toxicity(docs.limit(0), marks.limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(400)]
    rows = [(i, None if i == 5 else "\n".join(["menu"] * (i % 2) + rng.sample(lines, 3) + ["", "menu" if i % 9 == 0 else "x"]), "en", "h" if i % 4 else "k" if i % 8 else None, 1, "", "", "", "clash") for i in range(200)]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    hosts = collections.Counter(r[3] for r in rows)
    held = collections.Counter((r[3], x) for r in rows for x in set((r[1] or "").split("\n")))
    for r in rows:
        if r[1] is None or r[3] is None:
            want = r[1]
        else:
            want = "\n".join(x for x in r[1].split("\n") if not x or held[r[3], x] < 10 or held[r[3], x] <= 0.05 * hosts[r[3]])
        assert got[r[0]]["text"] == want


def test_language_counts_from_the_definition(spark):
    """Hits by sets of n-grams instead of bit masks: the same prediction, and rates that differ by false positives only."""
    rng = random.Random(14)
    sides = {"en": "the thing and wonder with shall".split(), "fr": "le chose et merveille avec déjà".split(), "nl": "het ding en wonder met zal".split()}
    some = [(" ".join(rng.choices(sides[x], k=rng.choice([8, 40]))), x) for x in rng.choices(list(sides), k=150)]
    setting = Setting()
    filters = learn(spark.createDataFrame(some, "text string, lang string"), setting, "text", "lang", F.lit(True))
    (t,) = chunks(pa.array([x for x, _ in some]))
    bare = [re.sub(rb"[^a-z\x80-\xff]", b" ", x.lower().encode()) for x, _ in some]
    names, hits, total = filters.names, np.zeros((len(some), 3)), np.zeros(len(some))
    for n in setting.grams:
        held = [[{x[i : i + n] for i in range(len(x) - n + 1)} for x, (_, y) in zip(bare, some, strict=True) if y == name] for name in names]
        share = [collections.Counter(g for d in own for g in d) for own in held]
        rate = [{g: c / len(own) for g, c in s.items()} for s, own in zip(share, held, strict=True)]
        kept = [{g for g, c in s.items() if c > 1 and r[g] >= setting.share * max(x.get(g, 0) for x in rate)} for s, r in zip(share, rate, strict=True)]
        for i, x in enumerate(bare):
            grams = [x[k : k + n] for k in range(len(x) - n + 1)]
            total[i] += len(grams)
            hits[i] += [sum(g in k for g in grams) for k in kept]
    want = hits / total[:, None]
    got = filters.rates(t)
    assert np.abs(got - want).max() < 0.01
    name, score = filters.predict(t)
    assert name == [names[k] for k in want.argmax(1)] and name == [y for _, y in some]
    assert score == pytest.approx(got.max(1) / got.sum(1))


def test_toxicity_score_from_the_definition(spark):
    """The score as a sum over pairs of terms; training lowers the loss of the constant score."""
    rng = random.Random(15)
    rows = []
    for i in range(900):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append((i, " ".join(rng.choices("alpha beta gamma delta".split(), k=8) + ["insult"] * a + ["group"] * b), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    settings_ = toxic.Setting()
    m = toxic.fit(docs, docs, settings_, F.lit(True), "text", "doc_id", "toxic")
    texts = [None, "", "alpha insult", "alpha insult group", *(x for _, x, _ in rows[:60])]
    (t,) = chunks(pa.array(texts))
    term, row = toxic.terms(t, settings_)
    got = m.score(t)
    for i in range(len(texts)):
        own = [m.number[x] for x in term[row == i] if m.number[x] >= 0]
        y = m.bias + sum(m.w[k] for k in own) + sum(float(m.v[a] @ m.v[b]) for i_, a in enumerate(own) for b in own[:i_])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-y)))
    y = np.array([z for _, _, z in rows[:60]])
    loss = lambda p: -np.mean(np.log(np.where(y, p, 1 - p)))
    assert loss(got[4:]) < loss(np.mean([z for _, _, z in rows])) / 2
    assert got[3] > 0.5 > got[2]


def test_repeated_ids_and_copies_stay_bounded(spark):
    """Copies and repeated ids are learned from once."""
    rows = [(1, "le chose et", "fr", 1)] * 400 + [(k, f"the thing {k}", "en", 0) for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    known = toxic._sample(docs, docs.select("doc_id", "toxic").distinct(), toxic.Setting(), F.lit(True), "text", "doc_id", "toxic")
    assert len(known) == 29
    assert languages(docs).count() == 428


@pytest.mark.parametrize("op", [quality_rules, token_counts, license_scan, line_dedup, languages])
def test_null_texts_and_very_long_ones(spark, op):
    """Only nulls; then one text of four megabytes beside short ones, with a null source and key."""
    assert op(table(spark, [None] * 5)).count() == 5
    long = "een heel lange tekst met woorden\n" * 120_000
    got = op(table(spark, [long, None, "x"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))))
    assert got.count() == 3 and got.filter("doc_id is null").count() == 1


def test_line_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "menu\nown " + str(i), "h", "mine", "mine", "mine") for i in range(6)], "doc_id long, text string, source string, _dedup_host string, _DEDUP_marks string, _dedup_kept string")
    got = line_dedup(docs, least_pages=2).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, f"own {i}", "h", "mine", "mine", "mine", 1) for i in range(6)]


@pytest.mark.parametrize("op", [quality_rules, token_counts, license_scan, line_dedup, languages])
def test_empty_table(spark, op):
    assert op(table(spark, []).limit(0)).count() == 0


def brute_spans(scanner, run):
    """Spans of a run of word numbers by comparing every place with every place of each template."""
    scan, out = scanner.scan, []
    for template, text in enumerate(scanner.texts):
        found = []
        for i in range(1, len(run) + 1):
            for j in range(1, len(text) + 1):
                n = 0
                while n < min(i, j) and run[i - 1 - n] == text[j - 1 - n]:
                    n += 1
                if n >= scan.least and not (i < len(run) and j < len(text) and run[i] == text[j]):
                    found.append((i, j, n))
        best = []
        for end, at, n in found:
            options = [(n, end - n)]
            for (e, a, _), (covered, first) in zip(found, best, strict=False):
                if e < end and a < at and end - n - e <= scan.gap and at - n - a <= scan.gap:
                    options.append((covered + min(end - max(e, end - n), at - max(a, at - n)), first))
            best.append(max(options))
        out += [(-c, -c / len(text), first, end, template) for (c, first), (end, _, _) in zip(best, found, strict=True) if c >= scan.cover * len(text)]
    chosen = []
    for covered, _, first, end, template in sorted(out):
        if all(end <= a or first >= b for _, a, b, _ in chosen):
            chosen.append((template, first, end, -covered))
    return chosen


def test_license_chains(spark):
    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.Scan())
    texts = [x.split() for several in licenses.TEMPLATES.values() for x in several]
    files = []
    for _ in range(40):
        w = rng.choices("zq the of and license software kk ll".split(), k=rng.randint(0, 12))
        for _ in range(rng.randint(0, 3)):
            own = list(rng.choice(texts))
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = rng.choices("zq the kk".split(), k=rng.randint(0, 14 if rng.random() < 0.2 else 2))
                own = own or ["zq"]
            w += own + rng.choices("zq the of and kk ll".split(), k=rng.randint(0, 30))
        files.append(w)
    files.append(texts[3] + texts[3] + ["zq"] * 30 + texts[3])
    got = {r["doc_id"]: r for r in license_scan(table(spark, [" ".join(w) for w in files])).collect()}
    several = 0
    for i, w in enumerate(files):
        want = brute_spans(scanner, [scanner.number.get(x, -1 - k) for k, x in enumerate(w)])
        labels = {scanner.names[t] for t, *_ in want}
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(labels | base))
        assert got[i]["score"] == pytest.approx(max((c / len(scanner.texts[t]) for t, _, _, c in want), default=0.5 if base else 0.0))
        assert got[i]["span_first"] == min((a for _, a, _, _ in want), default=None)
        assert got[i]["span_last"] == max((b - 1 for _, _, b, _ in want), default=None)
        several += len(want) > 1
    assert several > 5
