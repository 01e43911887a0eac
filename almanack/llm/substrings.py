"""Substring dedup by a compressed FM-index per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from almanack.llm.fm_index import FMIndex
from almanack.llm.passages import by_shard, contexts, keyed, occurrences, part, sealed, unlike, unsealed
from almanack.llm.session import drop, write
from almanack.llm.textkit import SPACES, covered, text_slices, word_bounds

WINDOW, K = 20, 10


def earliest(shard: dict, window: int) -> pa.RecordBatch:
    """For each window of each context: the least (d, start) of an equal window.

    A context is merged from its equals with the least of their places, so those that are alone with
    their anchor are done; the others are searched for in the index of the shard.
    """
    wins = shard["wins"].astype(np.int64)
    owner = np.repeat(np.arange(len(wins)), wins)
    first_d = shard["d"][owner]
    first_p = (shard["pos"][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)).astype(np.int32)
    chosen = unlike(shard)
    if chosen.any():
        first_d[chosen[owner]], first_p[chosen[owner]] = _search(part(shard, chosen), window)
    offsets = pa.array(np.concatenate(([0], np.cumsum(wins))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (first_d, first_p)]
    return pa.RecordBatch.from_arrays([pa.array(shard["ah"]), pa.array(shard["ch"]), *lists], ["ah", "ch", "fd", "fp"])


def _search(shard: dict, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(d, start) of the earliest equal of each window, by backward search."""
    sizes = shard["wins"].astype(np.int64) + window - 1
    words = b" ".join(shard["body"]).split()
    codes, _ = pd.factorize(np.array(words, object))
    begins = np.cumsum(sizes + 1) - sizes - 1  # a 0 follows each context
    sequence = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(sequence), bool)
    inside[begins + sizes] = False
    sequence[inside] = codes + 1
    index = FMIndex(sequence, window)

    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    ids, id_rank = np.unique(shard["d"], return_inverse=True)
    place = shard["pos"][owner].astype(np.int64) + np.arange(len(sequence)) - begins[owner]
    key = (id_rank[owner].astype(np.int64) << 32) | place

    wins = shard["wins"].astype(np.int64)
    window_owner = np.repeat(np.arange(len(wins)), wins)
    starts = begins[window_owner] + np.arange(len(window_owner)) - np.repeat(np.cumsum(wins) - wins, wins)
    best = key[starts]
    which, low, high = index.matching(sequence, starts + window, window)
    if len(which):
        spans, at = np.unique(low, return_inverse=True)
        ends = np.zeros(len(spans), np.int64)
        ends[at] = high
        ordered = np.append(key[index.suffixes], 0)
        best[which] = np.minimum.reduceat(ordered, np.column_stack((spans, ends)).ravel())[::2][at]
    return ids[best >> 32], (best & 0xFFFFFFFF).astype(np.int32)


def repeated_starts(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """_d, _t and the starts (word numbers) of windows that also start earlier."""
    found = occurrences(docs, window, k, words=True, keep=False)
    cold, hot, used = contexts(docs, found, window, words=True)
    first = by_shard(cold, lambda shard: earliest(shard, window), "ah long, ch long, fd array<long>, fp array<int>")
    if hot is not None:  # each window alone with its key: decided by its merged places
        least = write(hot.groupBy("wh").agg(F.min(F.struct("d", "pos")).alias("f")))
        lists = hot.select("ah", "ch", "s", "wh").join(least.hint("merge"), "wh").groupBy("ah", "ch").agg(F.sort_array(F.collect_list(F.struct("s", "f"))).alias("x"))
        first = first.unionByName(lists.select("ah", "ch", F.transform("x", lambda x: x["f"]["d"]).alias("fd"), F.transform("x", lambda x: x["f"]["pos"]).alias("fp")))
        used.append(least)
    first = write(first)
    for table in used:
        drop(table)
    late = F.filter(F.sequence(F.lit(0), F.col("wins") - 1), lambda i: (F.get("fd", i) < F.col("d")) | ((F.get("fd", i) == F.col("d")) & (F.get("fp", i) < F.col("pos") + i)))
    joined = found.join(first, ["ah", "ch"]).select("d", "t", F.transform(late, lambda i: F.col("pos") + i).alias("s")).where(F.size("s") > 0)
    starts = write(joined.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.flatten(F.collect_list("s")).alias("_starts")))
    drop(found)
    drop(first)
    return starts


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, texts: bool = False) -> DataFrame:
    """Remove each word inside a window of `window` words that also starts earlier.

    Words are runs of [^\\x20\\x09-\\x0D]; earlier is a smaller doc_id, or the same and an earlier
    word; windows are judged on the input. Contexts of repeated anchors are dealt to shards; each
    shard's distinct contexts are indexed (Burrows-Wheeler transform in a wavelet matrix of packed
    bits), every context is streamed through backward search, and the interval of each window that
    matches `window` words gives its earliest place.

    Returns doc_id, n_words, n_removed, kept_sha256, for each row of docs. With texts=True: docs with
    the words cut out of text, each with the white space after it, in all columns; texts that lose
    nothing stay as they are.

    Ids are whole numbers of any width. Null text has no words. Null ids come before all others. Rows of one id and equal texts count as
    one place and get equal results; rows of one id with different texts are ordered by word number
    alone. Texts of fewer words than a window lose nothing; an empty table gives no rows.
    """
    starts = repeated_starts(docs, window, k)
    rows = sealed(docs) if texts else docs.select("doc_id", "text")
    joined = keyed(rows).join(starts, ["_d", "_t"], "left").drop("_d", "_t")
    names = rows.columns

    def removals(batches):
        for batch, data, off in text_slices(batches):
            lists = batch.column("_starts")
            yield batch, data.tobytes(), off, [np.array(x.as_py()) if x.is_valid else None for x in lists]

    def digest(batches):
        for batch, raw, off, lists in removals(batches):
            n_words, n_removed, shas = [], [], []
            for r, starts in enumerate(lists):
                words = raw[off[r] : off[r + 1]].split()
                n_words.append(len(words))
                if starts is not None:
                    kept = ~covered(starts, window, len(words))
                    words = [w for w, x in zip(words, kept) if x]
                n_removed.append(n_words[-1] - len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def cleaned(batches):
        for batch, raw, off, lists in removals(batches):
            out = batch.column("text").to_pylist()
            for r, starts in enumerate(lists):
                if starts is None:
                    continue
                data = np.frombuffer(raw[off[r] : off[r + 1]], np.uint8)
                begins, _, _ = word_bounds(data, np.array([0, len(data)]), SPACES)
                gone = covered(starts, window, len(begins))
                # each word owns the bytes up to the next word; those before the first stay
                owner = np.zeros(len(data), np.int64)
                owner[begins] = 1
                keep = np.concatenate(([True], ~gone))[np.cumsum(owner)]
                out[r] = data[keep].tobytes().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column("text").type) if c == "text" else batch.column(c) for c in names], names)

    if texts:
        return unsealed(joined.mapInArrow(cleaned, rows.schema), docs)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(digest, schema)
