"""Exact n-gram Jaccard join by a size-aware heavy-light split."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.components import components
from almanack.llm.passages import keyed, sealed, unsealed
from almanack.llm.session import drop, write
from almanack.llm.textkit import LOWER, SPACES, U64, WordHasher, mix, row_starts, text_slices, word_bounds

#: Documents, by a hash of their ids, from which frequent shingles and the size boundary are taken.
SAMPLE_ROWS = 5_000
#: A shingle in this share of the sample's documents goes to the end of the order of shingles.
FREQUENT = 0.002
#: Members of a list, or of a candidate group, that are compared in one block.
LIST_BLOCK, GROUP_BLOCK = 4096, 1000
#: Relative cost of a scanned list entry to an enumerated subset.
SCAN_COST = 8.0


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n, m):
        """Least intersection of sets of n and m elements that are similar."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n):
        """Least size of a set similar to one of n."""
        return -(-self.num * n // self.den)

    def most(self, n):
        return self.den * n // self.num

    def prefix(self, n):
        return n - self.least(n) + 1

    def subsets(self, n: int, top: int) -> int:
        """Subsets that a set of n emits for partners where the smaller has at most `top`."""
        return sum(comb(n, self.overlap(n, m)) for m in range(self.least(n), self.most(n) + 1) if min(n, m) <= top)


def shingle_sets(data: np.ndarray, off: np.ndarray, hasher: WordHasher, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; all words as one shingle in short rows."""
    starts, ends, rows = word_bounds(data, off, SPACES)
    words = hasher.word_hashes(data, starts, ends)
    first = row_starts(rows, len(off) - 1)
    grams = hasher.gram_hashes(words, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield hasher.gram_hashes(words[a:b], int(b - a))
        else:
            yield np.zeros(0, U64)


def _set_hash(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set: of its size, sum and mixed parity."""
    if not len(s):
        return 0
    parts = np.array([np.bitwise_xor.reduce(mix(s)), s.sum(), len(s)], U64)
    tags = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], U64)
    return int(mix(np.bitwise_xor.reduce(mix(parts * tags), keepdims=True))[0].view(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of the elements by their low bits, in a power of two bits, one for each element or more."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _signatures(s: np.ndarray, t: Threshold, top: int) -> list[int]:
    """Hashes of the subsets of fixed size that decide pairs with a small side; the low bit tells pairs of unlike sizes."""
    n, out = len(s), []
    for m in range(t.least(n), t.most(n) + 1):
        if min(n, m) > top:
            continue
        c, unlike = t.overlap(n, m), int(n != m)
        tag = mix(np.array([min(n, m) * 100_003 + max(n, m)], U64))[0]
        for chosen in combinations(mix(s ^ tag), c):
            h = mix(np.array([np.add.reduce(np.array(chosen, U64)) ^ tag], U64))[0]
            out.append(int(((h & ~U64(1)) | U64(unlike)).view(np.int64)))
    return out


def _order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set by the global order: by hash, frequent shingles last."""
    if not len(frequent) or not len(s):
        return s
    at = np.searchsorted(frequent, s)
    at[at == len(frequent)] = 0
    late = frequent[at] == s
    return np.concatenate((s[~late], s[late]))


def _sample(docs: DataFrame, size: int, t: Threshold) -> tuple[np.ndarray, int]:
    """Frequent shingles, sorted, and the size up to which subsets are cheaper than lists."""
    n_docs = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("_d", "_t"), F.lit(max(1, n_docs // SAMPLE_ROWS))) == 0).select("text")

    def sets(batches):
        hasher = WordHasher(lower=True)
        for batch, data, off in text_slices(batches):
            rows = list(shingle_sets(data, off, hasher, size))
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            flat = np.concatenate(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["s"])

    taken = write(sample.mapInArrow(sets, "s array<long>"))
    limit = max(20, int(FREQUENT * min(n_docs, SAMPLE_ROWS)))
    counted = taken.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    frequent = np.sort(np.array([r.s for r in counted.select("s").toLocalIterator()], np.int64).view(U64))  # at most rows x shingles / limit
    sizes = {r.n: r.c for r in taken.groupBy(F.size("s").alias("n")).agg(F.count("*").alias("c")).where("n BETWEEN 1 AND 64").collect()}
    cost = lambda top: sum(c * (t.subsets(n, top) + (SCAN_COST * t.prefix(n) if n > top else 0)) for n, c in sizes.items())
    return frequent, min(range(25), key=cost)


def _by_key(batches, limit: int):
    """Tables of rows sorted by `key`, of about limit bytes, with every key whole."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * limit // max(1, 4 * batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            held.append(part)
            size += max(1, part.nbytes)
            if size >= limit:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield table.slice(0, end)
                    rest = pa.Table.from_batches(table.slice(end).to_batches())
                    held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(table: pa.Table):
    key = table.column("key").to_numpy()
    edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    return zip(edges[:-1], edges[1:])


class _Links:
    """Labels of a few nodes under union; only a tree of links leaves it."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        old = np.unique(np.append(self.label[others], self.label[i]))
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]

    def edges(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(node)))
        return node[at], node[self.label[at]]


def _may_be_similar(n: int, m: int, a: bytes, b: bytes, t: Threshold) -> bool:
    """Whether two bitmaps allow similarity; the wider is folded."""
    least = t.overlap(n, m)
    if min(n, m) < least:
        return False
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count() <= n + m - 2 * least


def _bitmap_links(n: np.ndarray, maps: list[bytes], t: Threshold) -> _Links:
    """Links pairs whose bitmaps allow similarity. The bits that differ are at most the elements that do."""
    links, width = _Links(len(n)), np.fromiter(map(len, maps), np.int64, len(maps))
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        wide = np.flatnonzero(width == 2 * w)
        rows = [np.frombuffer(b"".join(maps[i] for i in own), U64).reshape(len(own), -1)]
        if len(wide):
            double = np.frombuffer(b"".join(maps[i] for i in wide), U64).reshape(len(wide), -1)
            rows.append(double[:, : double.shape[1] // 2] ^ double[:, double.shape[1] // 2 :])
        bits, who = np.concatenate(rows), np.concatenate((own, wide))
        size = n[who]
        for i in range(len(own)):
            j = np.arange(i + 1, len(who))
            allowed = size[i] + size[j] - 2 * t.overlap(size[i], size[j])
            j = j[(np.minimum(size[i], size[j]) >= t.overlap(size[i], size[j]))]
            if not len(j):
                continue
            allowed = size[i] + size[j] - 2 * t.overlap(size[i], size[j])
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            close = j[differ <= allowed]
            if len(close):
                links.join(who[i], who[close])
    return links


def _exact_links(sets: list[np.ndarray], side: np.ndarray, t: Threshold) -> _Links:
    """Links similar sets, by scanning the inverted lists of each set's elements."""
    m = len(sets)
    links, n = _Links(m), np.fromiter(map(len, sets), np.int64, m)
    if m == 2:
        if len(np.intersect1d(*sets, assume_unique=True)) >= t.overlap(int(n[0]), int(n[1])):
            links.join(0, np.array([1]))
        return links
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(code, kind="stable")
    postings, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
    at = np.concatenate(([0], np.cumsum(n)))
    mixed = side.min() != side.max()
    for i in range(m):
        if (links.label == links.label[i]).all():
            break
        codes = code[at[i] : at[i + 1]]
        a, b = begin[codes], begin[codes + 1]
        lengths = b - a
        flat = np.repeat(a - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(postings[flat], minlength=m)
        close = shared >= t.overlap(n[i], n)
        if mixed:
            close &= side != side[i]
        close = np.flatnonzero(close)
        if len(close):
            links.join(i, close)
    return links


def _emit(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (list(zip(*pairs)) if pairs else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """rows with a column key for each pair of blocks of its group that it takes part in, and side, its block."""
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("sh", F.lit(7)), n).cast("int")
    return (
        rows.withColumns({"_n": n, "side": mine})
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("side", "_j"), F.greatest("side", "_j"))))
        .drop("_n", "_j")
    )


def similar_sets(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows: _d, _t, n, sh for each document; label: node, label of linked sets sh).

    1. Each text becomes a row of set size, set fingerprint, bitmap, and either the fixed-size
       subsets of its set (small sets) or its prefix in the order of shingles (others): two similar
       sets share a subset, or an element of their prefixes.
    2. Sets that share a subset are similar; each links to the least of them.
    3. Lists of prefix elements keep distinct sets only; lists with the same members count once.
       Members are compared by bitmaps, in blocks, and what may be similar is joined to groups.
    4. Within a group, the sets themselves are compared, in blocks, by scanning inverted lists.
    """
    t, docs = Threshold(num, den), keyed(docs.select("doc_id", "text")).select("_d", "_t", "text")
    frequent, top = _sample(docs, size, t)

    def describe(batches):
        hasher = WordHasher(lower=True)
        for batch, data, off in text_slices(batches):
            ns, hashes, maps, sigs, toks = [], [], [], [], []
            for s in shingle_sets(data, off, hasher, size):
                n = len(s)
                ns.append(n)
                hashes.append(_set_hash(s))
                listed = n > top
                maps.append(_bitmap(s) if listed else None)
                sigs.append(_signatures(s, t, top) if n and t.least(n) <= top else None)
                toks.append(_order(s, frequent)[: t.prefix(n)].view(np.int64) if listed else None)
            arrays = [batch.column("_d"), batch.column("_t"), pa.array(ns, pa.int32()), pa.array(hashes, pa.int64()), pa.array(maps, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(toks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["_d", "_t", "n", "sh", "bits", "sigs", "toks"])

    rows = write(docs.mapInArrow(describe, "_d long, _t int, n int, sh long, bits binary, sigs array<long>, toks array<long>"))

    sets_once = write(rows.select("sh", "n", "bits", "sigs", "toks").dropDuplicates(["sh"]))

    # small sets: all that share a subset of the size that decides are similar
    sigs = sets_once.select("sh", "n", F.explode(F.array_distinct("sigs")).alias("sig"))
    groups = sigs.groupBy("sig").agg(F.min("sh").alias("b"), F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    groups = groups.where("c > 1 AND (sig % 2 = 0 OR lo < hi)").select("sig", "b")
    light = sigs.join(groups, "sig").select(F.col("sh").alias("a"), "b").where("a <> b").distinct()

    # others: lists of at least two distinct sets; two whose sizes are too far apart make none
    tokens = sets_once.select("sh", "n", F.explode("toks").alias("tok"))
    counts = tokens.groupBy("tok").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sh")).alias("x"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    counts = counts.where((F.col("c") > 2) | ((F.col("c") == 2) & (den * F.col("lo") >= num * F.col("hi"))))
    lists = write(counts.groupBy("c", "x").agg(F.min("tok").alias("tok")).select("tok", "c"))
    bitmaps = sets_once.where("bits IS NOT NULL").select("sh", "n", "bits")
    members = _blocked(tokens.select("sh", "tok").join(lists, "tok").join(bitmaps, "sh"), "tok", "c", LIST_BLOCK)

    def candidates(batches):
        for table in _by_key(batches, 4 << 20):
            sh, n, maps, pairs = table.column("sh").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("bits").to_pylist(), []
            two = []
            for a, b in _groups(table):
                if b - a > 2:
                    pairs.append(_bitmap_links(n[a:b], maps[a:b], t).edges(sh[a:b]))
                elif b - a == 2 and _may_be_similar(int(n[a]), int(n[a + 1]), maps[a], maps[a + 1], t):
                    two.append(a)
            two = np.array(two, np.int64)
            yield _emit([*pairs, (sh[two], sh[two + 1])])

    possible = members.select("key", "sh", "n", "bits").repartition("key").sortWithinPartitions("key").mapInArrow(candidates, "a long, b long").distinct()
    group = components(possible)
    sizes = group.groupBy("label").agg(F.count("*").alias("c"))
    one = rows.groupBy(F.col("sh").alias("node")).agg(F.min(F.struct("_d", "_t")).alias("x"))  # a document for each set
    wanted = group.join(sizes, "label").join(one, "node").select(F.col("node").alias("sh"), "label", "c", F.col("x._d").alias("_d"), F.col("x._t").alias("_t"))

    def sets(batches):
        hasher = WordHasher(lower=True)
        for batch, data, off in text_slices(batches):
            found = [s.view(np.int64) for s in shingle_sets(data, off, hasher, size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sh", "label", "c")), pa.array(found, pa.list_(pa.int64()))], ["sh", "label", "c", "s"])

    full = _blocked(docs.join(wanted, ["_d", "_t"]).select("sh", "label", "c", "text").mapInArrow(sets, "sh long, label long, c long, s array<long>"), "label", "c", GROUP_BLOCK)

    def verify(batches):
        for table in _by_key(batches, 4 << 20):
            sh, side, pairs = table.column("sh").to_numpy(), table.column("side").to_numpy(), []
            lists = table.column("s").combine_chunks()
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for a, b in _groups(table):
                _, new = np.unique(sh[a:b], return_index=True)  # equal rows come twice
                new = a + new
                if len(new) > 1:
                    pairs.append(_exact_links([flat[offsets[i] : offsets[i + 1]] for i in new], side[new], t).edges(sh[new]))
            yield _emit(pairs)

    heavy = full.select("key", "sh", "side", "s").repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    links = write(light.unionByName(heavy))
    for used in (sets_once, lists, group):
        drop(used)
    return rows.select("_d", "_t", "n", "sh"), components(links)


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, keep_one: bool = False) -> DataFrame:
    """Join documents whose sets of word shingles have Jaccard similarity >= num / den, exactly.

    Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; a text of fewer than `size` words has
    all of them as its one shingle. Small sets enumerate subsets of the least deciding size; large
    sets scan inverted lists; the boundary is the one of least cost for the sizes of a sample (see
    similar_sets). Shingles and sets are compared by 64-bit fingerprints. No list, group or set of
    pairs is capped; a group of any size leaves a tree of links.

    Returns doc_id, n_shingles and component_id, the least doc_id reachable by links, for each row of
    docs. With keep_one=True: the rows of docs with the least id of each component, in all columns;
    of rows of that id, the one of the least text hash.

    Ids are whole numbers of any width. Null and empty texts have no shingles and link with nothing; with keep_one they all stay. Null ids
    come before all others. Equal rows are linked and keep_one keeps one; an empty table gives no rows.
    """
    rows, labels = similar_sets(docs, size, num, den)
    # the first document of each set, then of each component: few rows, both sides of each join plain tables
    sets = rows.where("n > 0").groupBy("sh").agg(F.min(F.struct("_d", "_t")).alias("first"))
    named = write(sets.join(labels.withColumnRenamed("node", "sh"), "sh", "left").select("sh", "first", F.coalesce("label", "sh").alias("label")))
    least = write(named.groupBy("label").agg(F.min("first").alias("first")))
    firsts = write(named.join(least.hint("merge"), "label").select("sh", least["first"]))
    drop(named)
    drop(least)
    own = rows.where("n > 0").join(firsts.hint("merge"), "sh").select("_d", "_t", "n", "first").unionByName(rows.where("n = 0").select("_d", "_t", "n", F.struct("_d", "_t").alias("first")))
    if not keep_one:
        null = F.lit(-(1 << 63))
        back = lambda c: F.when(F.col(c) != null, F.col(c)).cast(docs.schema["doc_id"].dataType)
        return own.select(back("_d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), back("first._d").alias("component_id"))
    kept = own.where((F.col("n") == 0) | ((F.col("_d") == F.col("first._d")) & (F.col("_t") == F.col("first._t"))))
    # rows that share an id and a text hash: one of them, but all without shingles
    kept = kept.groupBy("_d", "_t").agg(F.max("n").alias("_n"), F.count("*").alias("_c"))
    joined = keyed(sealed(docs)).join(kept, ["_d", "_t"])
    once = joined.where("_c = 1 OR _n = 0")
    twice = joined.where("_c > 1 AND _n > 0").groupBy("_d", "_t").agg(F.first(F.struct("doc_id", "text", "rest")).alias("x"))
    return unsealed(once.select("doc_id", "text", "rest").unionByName(twice.select("x.*")), docs)
