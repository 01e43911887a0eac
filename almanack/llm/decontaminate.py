"""Benchmark decontamination by hashed windows of normalised test words."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.session import drop, write
from almanack.llm.textkit import LOWER, NOT_ITEM_WORD, U64, WordHasher, covered, row_starts, text_slices, word_bounds

WINDOW = 13
#: Bytes of benchmark text whose windows are sent to the tasks at once, some 100 MB as a table in a worker. More text goes
#: in further passes, each written before the next.
BLOCK_BYTES = 2 << 20


def _windows_of(items: list[tuple[str | None, bytes]], window: int) -> dict[int, dict[int, list[tuple[bytes, tuple[str, ...]]]]]:
    """{words in the window: {hash: [(its words joined by a space, ids of its items)]}}."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    lengths: dict[bytes, int] = {}
    for item_id, text in items:
        data = LOWER[np.frombuffer(text, np.uint8)]
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_ITEM_WORD)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts, ends)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            joined = b" ".join(words[i : i + size])
            owners[joined].update(() if item_id is None else (item_id,))
            lengths[joined] = size
    hasher, by_length = WordHasher(), defaultdict(lambda: defaultdict(list))
    for joined, ids in owners.items():
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_ITEM_WORD)
        h = int(hasher.gram_hashes(hasher.word_hashes(data, starts, ends), lengths[joined])[0])
        by_length[lengths[joined]][h].append((joined, tuple(sorted(ids))))
    return {n: dict(hashes) for n, hashes in by_length.items()}


def _blocks(benchmark: DataFrame, limit: int):
    """Lists of (id, text bytes) of at most limit bytes, or one item, streamed to the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: str | None = None) -> DataFrame:
    """Find the words of documents (doc_id, text, others) inside windows of benchmark items.

    A window is `window` consecutive words of an item, or all of an item with fewer. The windows of
    at most block_bytes of benchmark text, or of one longer item, are broadcast as a hash table; a
    larger benchmark is read in blocks, each a further narrow pass whose hits are written before the
    next block is read, so driver and workers hold one block at a time. Each hash hit is compared
    word by word. Documents are not shuffled, so frequent passages make no hot task.

    Adds n_words, n_hit, n_items, items_sha256 and contaminated. With clean="spans" it instead
    returns docs with hit words cut out of contaminated rows' texts, with clean="documents" docs
    without contaminated rows; both keep all columns. Null text has no words; words of an
    item without an id are hits, but it is in neither n_items nor items_sha256; null items are ignored;
    equal rows each get their result; an empty benchmark hits nothing.
    """
    columns = docs.columns
    if clean is None:
        docs = docs.select("doc_id", "text")
        columns = docs.columns
    hits_type = "struct<words: array<int>, items: array<string>>"
    scratch = "_hits"
    while scratch in columns:
        scratch += "_"
    df = docs.withColumn(scratch, F.lit(None).cast(hits_type))
    held = None
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks)
    while (following := next(blocks, None)) is not None:
        passed = write(df.mapInArrow(_pass(_windows_of(block, window), scratch), df.schema))
        if held is not None:
            drop(held)
        df = held = passed
        block = following
    finish, schema = _finish(df, scratch, columns, clean)
    hits = _pass(_windows_of(block, window), scratch)
    return df.mapInArrow(lambda batches: finish(hits(batches)), schema)


def _pass(tables: dict, scratch: str):
    def run(batches):
        hasher = WordHasher()
        sorted_hashes = {n: np.sort(np.fromiter(t, U64, len(t))) for n, t in tables.items()}
        for batch, raw, off in text_slices(batches):
            data = LOWER[raw]
            starts, ends, rows = word_bounds(data, off, NOT_ITEM_WORD)
            first = row_starts(rows, batch.num_rows)
            words = hasher.word_hashes(data, starts, ends)
            marked, items = defaultdict(list), defaultdict(set)
            for n, hashes in sorted_hashes.items():
                grams = hasher.gram_hashes(words, n)
                if not len(grams):
                    continue
                at = np.searchsorted(hashes, grams)
                at[at == len(hashes)] = 0
                for i in np.flatnonzero((hashes[at] == grams) & (rows[: len(grams)] == rows[n - 1 :])):
                    joined = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n]))
                    for text, ids in tables[n][int(grams[i])]:
                        if text == joined:
                            r = int(rows[i])
                            marked[r].append(np.arange(i - first[r], i - first[r] + n))
                            items[r].update(ids)
            old = batch.column(scratch)
            found = []
            for r in range(batch.num_rows):
                was = old[r].as_py() if old[r].is_valid else None
                if r in marked or was:
                    now = np.unique(np.concatenate([*marked[r], np.array(was["words"] if was else [], np.int64)]))
                    found.append({"words": now.tolist(), "items": sorted(items[r] | set(was["items"] if was else ()))})
                else:
                    found.append(None)
            columns = [pa.array(found, old.type) if name == scratch else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _finish(df: DataFrame, scratch: str, columns: list[str], clean: str | None):
    import pyspark.sql.types as T

    kept = [f for f in df.schema.fields if f.name != scratch]
    if clean is None:
        kept = [f for f in kept if f.name == "doc_id"]
        schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    else:
        schema = T.StructType(kept)

    def run(batches):
        for batch, raw, off in text_slices(batches):
            starts, ends, rows = word_bounds(LOWER[raw], off, NOT_ITEM_WORD)
            n_words = np.bincount(rows, minlength=batch.num_rows)
            first = row_starts(rows, batch.num_rows)
            hits = batch.column(scratch).to_pylist()
            n_hit = np.array([len(h["words"]) if h else 0 for h in hits], np.int64)
            bad = (n_hit > 0) & (20 * n_hit >= n_words)
            if clean is None:
                items = [h["items"] if h else [] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(bad)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )
                continue
            if clean == "documents":
                out = batch.filter(pa.array(~bad))
                texts = out.column("text")
            else:
                out, texts = batch, batch.column("text").to_pylist()
                for r in np.flatnonzero(bad):
                    gone = np.zeros(off[r + 1] - off[r], bool)
                    w = first[r] + np.array(hits[r]["words"])
                    for a, b in zip(starts[w] - off[r], ends[w] - off[r]):
                        gone[a:b] = True
                    texts[r] = raw[off[r] : off[r + 1]][~gone].tobytes().decode("utf-8", "replace")
                texts = pa.array(texts, batch.column("text").type)
            yield pa.RecordBatch.from_arrays([texts if f.name == "text" else out.column(f.name) for f in kept], [f.name for f in kept])

    return run, schema
