"""Odd rows through every operator that returns whole documents, and the pipeline against plain Python."""

import random
import re
import zlib

import pytest
from test_jaccard import brute
from test_passages import brute_bytes, brute_words

CLASHING = ["_d", "_t", "_n", "_c", "_r", "_x", "_starts", "_lo", "_hi", "_hits", "rest", "n", "sh", "first", "label", "fold", "x"]


def clashing(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(d, t, *(f"{c}-{i}" for c in CLASHING)) for i, (d, t) in enumerate(rows)], schema)


def sample_rows(seed=3):
    rng = random.Random(seed)
    fill = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 99)) for _ in range(n))
    passage = fill(60)
    texts = [None, "", " ", "one", fill(40), fill(40), passage, fill(10) + " " + passage, passage + " " + fill(80), "a " * 120]
    return list(enumerate([*texts, texts[4], texts[4] + " tail"]))


@pytest.mark.parametrize("stage", ["near_duplicates", "substrings", "suffixes", "decontamination", "toxicity"])
def test_columns_of_any_name_stay(spark, stage):
    from almanack.llm.decontaminate import scan
    from almanack.llm.jaccard import jaccard_components
    from almanack.llm.substrings import substring_dedup
    from almanack.llm.suffix_array import suffix_dedup
    from almanack.llm.toxicity import toxicity

    rows = sample_rows()
    docs = clashing(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", rows[6][1])], "item_id string, text string")
    run = {
        "near_duplicates": lambda d: jaccard_components(d, keep_one=True), "substrings": lambda d: substring_dedup(d, texts=True), "suffixes": lambda d: suffix_dedup(d, texts=True),
        "decontamination": lambda d: scan(d, items, clean="documents"), "toxicity": lambda d: toxicity(d, none, keep_clean=True),
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    for r in out.collect():
        assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASHING)
    assert run(docs.limit(0)).count() == 0


def test_columns_named_twice_stay(spark):
    from almanack.llm.substrings import substring_dedup

    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, one string, two string").toDF("doc_id", "text", "same", "same")
    assert [tuple(r) for r in substring_dedup(docs, texts=True).collect()] == [(1, "a b", "x", "y")]


def test_ids_must_be_whole_numbers(spark):
    from almanack.llm.jaccard import jaccard_components
    from almanack.llm.substrings import substring_dedup
    from almanack.llm.suffix_array import suffix_dedup

    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    for operator in (jaccard_components, substring_dedup, suffix_dedup):
        with pytest.raises(TypeError, match="whole number"):
            operator(docs)
    small = spark.createDataFrame([(1, "x y z w"), (2, "x y z w")], "doc_id int, text string")
    assert sorted(tuple(r) for r in jaccard_components(small).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_repeated_and_null_ids_of_bytes(spark):
    from almanack.llm.suffix_array import suffix_dedup

    text = "".join(random.Random(5).choices("abcdefgh ", k=900))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (5, "short"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(docs).collect())
    assert got == [(-1, 0, 0, 0), (-1, 900, 900, 1), (4, 900, 900, 1), (4, 900, 900, 1), (5, 5, 0, 0)]


def test_very_long_texts(spark):
    import public_tokenizers

    from almanack.llm.bpe_count import token_counts
    from almanack.llm.decontaminate import scan
    from almanack.llm.jaccard import jaccard_components
    from almanack.llm.packing import pack
    from almanack.llm.substrings import substring_dedup

    rng = random.Random(9)
    words = [f"w{rng.randint(0, 1 << 40):x}" for _ in range(500_000)]
    long, copied = " ".join(words), " ".join(words[1000:1100])
    assert len(long) > 5_000_000
    docs = spark.createDataFrame([(1, long), (2, "before " + copied), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {1: (500_000, 0), 2: (101, 100), 3: (0, 0)}
    assert {r.doc_id: r.n_shingles for r in jaccard_components(docs).collect()} == {1: 499_997, 2: 98, 3: 0}
    items = spark.createDataFrame([("i", copied)], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in scan(docs, items).collect()} == {1: (100, False), 2: (100, True), 3: (0, False)}
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").sum("length").collect()
    tokens = {r.doc_id: r.doc_tokens for r in pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "doc_tokens").distinct().collect()}
    assert {r.doc_id: r["sum(length)"] for r in packed} == tokens and tokens[1] > 500_000 and tokens[3] == 1
    assert {r.doc_id: r.n_tokens > 500_000 for r in token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()} == {1: True, 2: False, 3: False}


def test_benchmark_of_many_blocks(spark):
    from almanack.llm.decontaminate import scan

    rng = random.Random(11)
    fill = lambda n: [rng.choice("abcdefg") + rng.choice("hijkl") for _ in range(n)]
    texts = [fill(rng.randint(3, 60)) for _ in range(40)]
    items = spark.createDataFrame([(f"i{i}", " ".join(t[:20])) for i, t in enumerate(texts)], "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(texts[i % 40] + fill(5) + texts[(i * 7) % 40])) for i in range(80)], "doc_id long, text string")
    whole = sorted(tuple(r) for r in scan(docs, items).collect())
    assert sorted(tuple(r) for r in scan(docs, items, block_bytes=100).collect()) == whole
    assert max(r[3] for r in whole) > 1


def test_byte_shards_against_plain_python(spark):
    from almanack.llm.shards import byte_shards

    rng = random.Random(2)
    rows = [(rng.randint(0, 400), rng.choice([None, "", "é" * rng.randint(0, 50), "x" * rng.randint(0, 300)])) for _ in range(300)] + [(None, "n")] * 3
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    total, at, want, slots = sum(len((t or "").encode()) + 1 for _, t in rows), 0, [], {}
    for d, t in sorted(rows, key=key):
        size = len((t or "").encode()) + 1
        shard = min(15, (2 * at + size) * 16 // (2 * total))
        want.append((d, size, zlib.crc32((t or "").encode()), "bytes", shard, slots.get(shard, 0), None))
        slots[shard], at = slots.get(shard, 0) + 1, at + size
    got = [tuple(r) for r in byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    order = lambda r: (r[4], r[5])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_pipeline_stages_against_plain_python(spark):
    """Each stage's kept ids and texts, on its own input, with the pipeline's settings."""
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = {r.doc_id: r.text for r in p.near_duplicates(spark, docs, folder).collect()}
    linked = brute(rows, 5, 80, 100)
    assert near == {d: t for d, t in rows if linked[d][1] == d or linked[d][0] == 0}
    left = [(d, near[d]) for d in sorted(near)]
    kept = spark.createDataFrame(left, "doc_id long, text string")
    cut = {r.doc_id: r.text for r in p.substrings(spark, kept, folder).collect()}
    want = brute_words(left, 20)
    import hashlib

    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    assert cut.keys() == want.keys()
    for d, t in cut.items():
        assert hashlib.sha256(b" ".join(words(t))).hexdigest() == want[d][2] and len(words(t)) == want[d][0] - want[d][1]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(plain, items) if w for i in range(len(w) - min(13, len(w)) + 1)}
    clean = {}
    for d, t in cut.items():
        w, hit = plain(t), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[d] = t
    frame = spark.createDataFrame(sorted(cut.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in p.decontamination(spark, frame, folder).collect()} == clean
    pieces = p.packing(spark, spark.createDataFrame(sorted(clean.items()), "doc_id long, text string"), folder).collect()
    at = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0)
        at[r.doc_id] = r.start + r.length
    assert at == {r.doc_id: r.doc_tokens for r in pieces} and at.keys() == clean.keys()


def test_stages_take_empty_and_null_rows(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(None, None, "x"), (1, None, "y"), (1, None, "y"), (2, "", None), (3, "two words", None)], "doc_id long, text string, _t string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 5, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert {r.doc_id for r in p.packing(spark, docs, folder).collect()} == {None, 1, 2, 3}


def test_bytes_of_a_hot_anchor(spark):
    """One line in many texts, with and without other neighbours."""
    from almanack.llm.suffix_array import suffix_dedup

    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh", k=300))
    rows = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 120))) + line + ("tail" * 40 if i % 5 == 0 else str(i))) for i in range(120)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_bytes(rows, 400)
