"""Learned operators: held-out accuracy, brute-force statistics, odd rows."""

import re
import zlib
from collections import Counter

import pytest
import xxhash

ODD = [None, "", " \n\t ", "12 34 !!", "a", "é", "word " * 12, "the same line\nthe same line\n\n\nother", "a b c d e a b c d e", "#*$%&|<> #", "x" * 9000, "É É É É É É"]


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(i if i else None, t, None, "s", 1) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, score string, rem int")


def test_language(spark, tables):
    from almanack.llm.language import languages

    docs = tables[0]
    both = docs.select("doc_id", "text", "lang").unionByName(odd(spark).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang"))
    got = {r.doc_id: r for r in languages(both).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in want if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (d in set(held)) for d in want)
    assert sum(got[d].lang_pred == want[d] for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, t in enumerate(ODD):
        if i and not any(c.isalpha() for c in t or ""):
            assert got[1000000 + i].lang_pred == "und"
        elif i:
            assert got[1000000 + i].lang_pred in set(want.values())
    assert {r.lang_pred for r in languages(odd(spark)).collect()} == {"und"}
    assert languages(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    import random

    from almanack.llm.language import languages

    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)) for _ in range(206)]
    rows = [(206 * j + i, t, f"l{i:03d}") for i, t in enumerate(texts) for j in range(9)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {d: lang for d, _, lang in rows}
    assert {want[r.doc_id] for r in got if not r.held_out} == set(want.values())
    assert len(got) == len(rows) and all(r.lang_pred == want[r.doc_id] for r in got)


def test_mixture_of_two_languages():
    import numpy as np

    from almanack.llm.language import mixture

    p = np.array([[0.7, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.2, 0.8]])
    counts = 10000 * p @ np.array([0.6, 0.0, 0.4])
    assert np.allclose(mixture(counts, p, 1.0, rounds=500), [0.6, 0, 0.4], atol=0.05)


def test_toxicity(spark, tables):
    from almanack.llm.toxicity import toxicity

    docs, labels = tables
    rows = toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = toxicity(docs, labels, keep_clean=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}
    assert toxicity(odd(spark), labels.limit(0)).count() == len(ODD)
    assert toxicity(odd(spark), labels.unionByName(labels)).count() == len(ODD)
    assert toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    from almanack.llm.toxicity import toxicity

    # what tells the labels apart stands after 80,000 bytes
    docs = spark.range(120).selectExpr("id AS doc_id", "concat(repeat('plain words of no note ', 3500), IF(id % 3 = 0, 'grobian lout grobian', 'gentle host gentle')) AS text")
    labels = spark.range(120).selectExpr("id AS doc_id", "IF(id % 3 = 0, 1, 0) AS toxic")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 120 and all(r.predicted == (r.doc_id % 3 == 0) for r in rows)


def test_trees_and_isotonic_regression():
    import numpy as np

    from almanack.llm.toxicity import BoostedTrees, isotonic

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500], np.ones(1500))
    assert (((model.raw(x[1500:]) > 0) == y[1500:]).mean()) > 0.95
    s, v = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert np.allclose(np.interp([1, 2, 3, 4], s, v), [0, 0.5, 0.5, 1]) and (np.diff(v) >= 0).all()


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_quality_against_brute_force(spark, tables):
    from almanack.llm import quality as q

    docs, labels = tables
    both = docs.select("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = both.collect()
    got = {r.doc_id: r for r in q.quality(both, labels).collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.lower().encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), a_seed) for a_seed, b in ((xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42), b) for a, b in zip(h, h[1:]))]
        return [signed(x) % q.BUCKETS for x in h + two]

    import math

    raw, target, bags = Counter(), Counter(), {r.doc_id: grams(r.text) for r in rows}
    for d, g in bags.items():
        raw.update(g)
        if d in trusted:
            target.update(g)
    n_raw, n_target, b = sum(raw.values()), sum(target.values()), q.BUCKETS
    prior = [(raw[i] + 1) / (n_raw + b) for i in range(b)]
    ratio = [math.log((target[i] + b * prior[i]) / (n_target + b)) - math.log(prior[i]) for i in range(b)]
    for r in rows:
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_statistics(r.text)
        score = sum(ratio[i] for i in bags[r.doc_id]) / max(1, len(bags[r.doc_id]))
        assert abs(x.score - score) < 1e-5
        assert not (x.base_failed and x.kept)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [d for d, v in truth.items() if v == 1 and not got[d].base_failed]
    assert sum(got[d].kept for d in good) >= 0.97 * len(good)
    bad = [d for d, v in truth.items() if v == 0]
    assert sum(got[d].kept for d in bad) <= 0.2 * len(bad)
    assert q.quality(docs.limit(0), labels).count() == 0 and q.quality(odd(spark), labels.limit(0)).count() == len(ODD)


def test_quality_target_of_all_trusted_documents(spark):
    import math

    import numpy as np

    from almanack.llm import quality as q

    # more than 20,000 trusted documents, one in 25 of another kind, and others that nobody trusts
    kinds = ["one two three four five six seven eight nine ten eleven", "red green blue black white grey pink brown gold teal lime mint", "buy now cheap pills click here win cash fast free money today"]
    kind = lambda i: 2 if i >= 25000 else int(i % 25 == 0)
    docs = spark.createDataFrame([(i, kinds[kind(i)]) for i in range(26000)], "doc_id long, text string")
    labels = spark.range(25000).selectExpr("id AS doc_id", "1 AS quality")
    got = q.quality(docs, labels).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) % q.BUCKETS for x in h + two]

    raw, target, bags, b = Counter(), Counter(), [grams(k) for k in kinds], q.BUCKETS
    for bag, n, n_trusted in zip(bags, (24000, 1000, 1000), (24000, 1000, 0)):
        for g in bag:
            raw[g] += n
            target[g] += n_trusted
    n_raw, n_target = sum(raw.values()), sum(target.values())
    prior = [(raw[i] + 1) / (n_raw + b) for i in range(b)]
    ratio = [math.log((target[i] + b * prior[i]) / (n_target + b)) - math.log(prior[i]) for i in range(b)]
    score = [sum(ratio[g] for g in bag) / len(bag) for bag in bags]
    spread = math.sqrt(sum(x * x for x in ratio) / b)
    eased = [s + 3 * spread / math.sqrt(len(bag)) for s, bag in zip(score, bags)]
    limit = np.quantile([eased[kind(i)] for i in range(25000)], 0.002)
    assert len(got) == 26000
    for r in got:
        assert abs(r.score - score[kind(r.doc_id)]) < 1e-5 and r.kept == (eased[kind(r.doc_id)] >= limit - 1e-6)


def test_quantile(spark):
    import random

    import numpy as np

    from almanack.llm.quality import _quantile

    draw = random.Random(5)
    for values in ([1.5], [2.0] * 30000, [draw.gauss(0, 1) for _ in range(25000)] + [-1e9, 1e9] + [0.25] * 12000):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        assert all(abs(_quantile(rows, p) - np.quantile(values, p)) < 1e-9 * max(1, abs(np.quantile(values, p))) for p in (0, 0.002, 0.5, 1))
    assert _quantile(rows.limit(0), 0.5) is None


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and docs.count() == len(now) > 0.5 * len(ids), name
        ids = now
    packed = p.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == ids
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in p.packing(spark, docs, sf).collect())
    assert sum(r.length for r in packed) == sum(w[2] for w in want)
