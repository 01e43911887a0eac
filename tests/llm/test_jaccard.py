"""Exact Jaccard components against brute force."""

import random
import re

import pytest


def brute(rows, size=4, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def mutated(seed):
    rng = random.Random(seed)
    fill = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nopqrstuvwxyz") + str(rng.randint(0, 30)) for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c", "A b c", "a b c d", "x " * 50, "x " * 90]
    for length in (5, 6, 8, 10, 11, 12, 16, 17, 19, 20, 23, 27, 40, 90, 300):
        base = fill(length)
        for i in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 40))):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w[at] = fill(1)[0]
                elif kind < 0.7:
                    del w[at]
                else:
                    w.insert(at, fill(1)[0])
            if i % 3 == 0:
                w = w[: rng.randint(max(1, length - 5), length)]
            if i % 5 == 0:
                w = [x.upper() for x in w]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed,top,block", [(1, None, None), (2, 20, 3), (3, 0, 2)])
def test_components_against_brute_force(spark, monkeypatch, seed, top, block):
    from almanack.llm import jaccard

    texts = mutated(seed)
    if seed == 1:
        texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    if block:
        monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
        monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
        sample = jaccard._sample
        monkeypatch.setattr(jaccard, "_sample", lambda *a: (sample(*a)[0], top))
    rows = list(enumerate(texts))
    want = brute(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sh string, n int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.jaccard_components(docs).collect()}
    assert got == want
    assert sum(1 for d, (_, c) in want.items() if c != d) > 50
    if seed == 1:
        kept = jaccard.jaccard_components(docs, keep_one=True)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_repeated_and_null_rows(spark):
    from almanack.llm.jaccard import jaccard_components

    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, None), (6, None), (7, "q")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == [(-1, 2, None), (4, 2, None), (4, 2, None), (5, 0, 5), (6, 0, 6), (7, 1, 7)]
    kept = [r.doc_id for r in jaccard_components(docs.where("doc_id > 3"), keep_one=True).collect()]
    assert sorted(kept) == [4, 5, 6, 7]
    assert jaccard_components(docs.limit(0)).count() == 0
