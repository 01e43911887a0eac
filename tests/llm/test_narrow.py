"""Operators that read each text once: packing, decontamination, token counts, shards."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

DIRS = ["/root/testdata/sf0.001"]
ODD = [None, "", " ", "a", "don't STOP.  now\n\n<|endoftext|> x<|endoftext|>", "É é é  İ ẞ", "!!!???...", "x" * 5000, "word word. word, Word; " * 900, "\x00\x1f ​", "ab1２③ 12345", "a" * 3 + "́b."]


def frame(spark, texts, ids=None):
    rows = [(i, t, "n", 1) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, size int")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    return frame(spark, ODD + [r.text for r in real])


def test_packing_round_trip(spark, docs):
    from almanack.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, path, tokens=True).collect():
        assert r.length == len(r.ids) >= 1 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        pieces[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length, r.seq_length))
    for doc, ids in want.items():
        assert [i for _, part in sorted(pieces[doc]) for i in part] == ids
    for parts in sequences.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 2048 and at & (at - 1) == 0


def test_packing_letters_that_become_marks(spark):
    from almanack.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"ab{c}{mark} {c}{mark}" for c in ("\u0130", "\u0958", "\u00e9", "\u1e9e") for mark in ".,;:!?"]
    got = defaultdict(list)
    for r in sorted(pack(frame(spark, texts), path, tokens=True).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += r.ids
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_packing_plan_keeps_every_token():
    from almanack.llm.packing import plan

    for lengths in ([1], [2048], [2049, 1, 1], [5000, 3, 700, 1025, 64, 65], list(range(1, 300)), []):
        seen = defaultdict(list)
        for s in plan(lengths, 2048, 64):
            size = sum(p[2] for p in s)
            assert 0 < size <= 2048 and size & (size - 1) == 0
            for d, start, n in s:
                seen[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, m in sorted(seen[d]):
                assert start == at
                at += m
            assert at == n


def test_token_counts_equal_the_library(spark, docs):
    from almanack.llm.bpe_count import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts(docs, path, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        text = r.text or ""
        assert got[r.doc_id].n_tokens == len(library.encode(text, add_special_tokens=False).ids), text[:50]
        assert got[r.doc_id].n_bytes == len(text.encode())
        assert got[r.doc_id].over_limit == (got[r.doc_id].n_tokens > 1024)


def brute_contamination(docs, items, window=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination_against_brute_force(spark, block):
    from almanack.llm.decontaminate import scan

    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "Short one!"), (901, "é"), (902, ""), (903, None), (904, "Short ONE")]
    texts = ODD + real + ["so short.one é", "SHORT--ONE", items[0][1], items[1][1].upper(), "x " + " ".join(items[2][1].split()[:13])]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(list(enumerate(texts)), items)
    got = {r.doc_id: tuple(r)[1:] for r in scan(docs, bench, block_bytes=block).collect()}
    assert got == want
    assert sum(w[4] for w in want.values()) > 3
    kept = scan(docs, bench, block_bytes=block, clean="documents")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    cut = {r.doc_id: r.text for r in scan(docs, bench, clean="spans").collect()}
    assert all(cut[d] == t for d, t in enumerate(texts) if not want[d][4]) and len(cut) == len(texts)
    none = scan(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)
    assert scan(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_by_items_without_an_id(spark, block):
    from almanack.llm.decontaminate import scan

    words = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [words, "short one", "other words", "known item"])
    bench = spark.createDataFrame([(None, words), (None, "short one"), (7, "known item"), (None, "known item"), (None, None)], "item_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in scan(docs, bench, block_bytes=block).collect()}
    assert got == {0: (20, 20, 0, sha(""), True), 1: (2, 2, 0, sha(""), True), 2: (2, 0, 0, sha(""), False), 3: (2, 2, 1, sha("7"), True)}
    assert [r.doc_id for r in scan(docs, bench, block_bytes=block, clean="documents").collect()] == [2]


def test_byte_shards(spark):
    from almanack.llm.shards import byte_shards

    texts = [None, "", "é" * 40, *["word " * (i % 90) for i in range(700)]]
    docs = frame(spark, texts, [None, *range(len(texts) - 1)])
    rows = byte_shards(docs.union(docs.limit(5)).repartition(7)).collect()
    assert len(rows) == len(texts) + 5
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        text = texts[0 if r.doc_id is None else r.doc_id + 1] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes"
        sizes[r.shard] += r.size
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) < 2 * 451
    order = [d for s in sorted(slots) for _, d in sorted(slots[s])]
    assert order == sorted(order)
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert byte_shards(docs.limit(0)).count() == 0
