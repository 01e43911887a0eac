"""Exact substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest


def brute_words(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = {}
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = {}
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    fill = lambda n: [word() for _ in range(n)]
    common, line = fill(55), fill(13)
    docs = [None, "", "  \n", " ".join(fill(19)), "a " * 300, ("b " * 7 + "c ") * 40]
    for i in range(60):
        w = fill(rng.randint(0, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = common[rng.randint(0, 20) : rng.randint(35, 55)]
        if i % 4 == 0:
            w[0:0] = line
        docs.append("\t".join(w) if i % 7 == 0 else " ".join(w) + " ")
    docs += [docs[20], docs[20], docs[21] + docs[22], docs[22] + " " + docs[22]]
    return docs


def rows_of(spark, name):
    return [r.text for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()]


@pytest.mark.parametrize("window,k", [(20, 10), (5, 2)])
def test_substring_dedup(spark, window, k):
    from almanack.llm.substrings import substring_dedup

    texts = planted() + (rows_of(spark, "documents") if window == 20 else [])
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    want = brute_words(sorted(rows), window)
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, d string, pos int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup(docs, window, k).collect()}
    assert got == want
    assert sum(1 for w in want.values() if w[1]) > 10
    clean = substring_dedup(docs, window, k, texts=True)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert len((r.text or "").encode().split()) == want[r.doc_id][0] - want[r.doc_id][1]
        if not want[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
    assert substring_dedup(docs.limit(0), window, k).count() == 0


def test_repeated_rows_are_one_place(spark):
    from almanack.llm.substrings import substring_dedup

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("window,k", [(400, 128), (40, 12)])
def test_suffix_dedup(spark, window, k):
    from almanack.llm.suffix_array import suffix_dedup

    texts = planted(2) + ["z" * 900, "yx" * 300] + (rows_of(spark, "documents")[:80] if window == 400 else [])
    rows = list(enumerate(texts))
    want = brute_bytes(rows, window)
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, lo string, n int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(docs, window, k).collect()}
    assert got == want
    assert sum(1 for w in want.values() if w[1]) > 5
    clean = suffix_dedup(docs, window, k, texts=True)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert suffix_dedup(docs.limit(0), window, k).count() == 0


def test_two_stage_sorting():
    from almanack.llm.suffix_array import suffix_array

    rng = random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice(rng.choice([b"ab", b"abc", bytes(range(200))])) for _ in range(rng.randint(1, 80)))
        text += text[: rng.randint(0, len(text))]
        for depth in (4, 1000):
            order = suffix_array(np.frombuffer(text, np.uint8), depth)
            assert sorted(order) == list(range(len(text)))
            heads = [text[i : i + depth] for i in order]
            assert heads == sorted(heads)


def test_fm_index_counts():
    from almanack.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)
    sequence = rng.integers(1, 5, 300)
    sequence[[60, 150, 299]] = 0
    index = FMIndex(sequence, 6)
    s = sequence.tolist()
    for i in range(0, 290, 7):
        for n in range(1, 7):
            pattern = s[i : i + n]
            if 0 in pattern:
                continue
            low, high = index.starts[pattern[-1]], index.starts[pattern[-1] + 1]
            low, high = np.array([low]), np.array([high])
            for c in pattern[-2::-1]:
                low, high = index.extend(np.array([c]), low, high)
            found = {int(x) for x in index.suffixes[low[0] : high[0]]}
            assert found == {j for j in range(len(s)) if s[j : j + n] == pattern}


@pytest.mark.parametrize("hot", [0, 2, 8])
def test_windows_of_hot_anchors_are_dealt_one_by_one(spark, monkeypatch, hot):
    from almanack.llm import passages
    from almanack.llm.substrings import substring_dedup
    from almanack.llm.suffix_array import suffix_dedup

    monkeypatch.setattr(passages, "HOT_CONTEXTS", hot)
    rows = list(enumerate(planted(7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup(docs).collect()} == brute_words(rows, 20)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup(docs, window=60, k=20).collect()} == brute_bytes(rows, 60)
