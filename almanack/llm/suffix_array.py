"""Suffix-array dedup of byte strings by two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from almanack.llm.passages import by_shard, contexts, keyed, occurrences, part, sealed, unlike, unsealed
from almanack.llm.session import drop, write
from almanack.llm.textkit import BYTE_BASE, BYTE_VALUES, Rolling, covered, text_slices

WINDOW, K = 400, 128
#: Ends each context; never a byte of UTF-8.
END = 0xFF


def _below_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last isn't."""
    rises = np.zeros(len(text), bool)
    rises[:-1] = text[:-1] < text[1:]
    # equal bytes take the answer of the first place where the text changes
    change = np.append(np.flatnonzero(text[:-1] != text[1:]), len(text) - 1)
    return rises[change[np.searchsorted(change, np.arange(len(text)))]]


def _sort_direct(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes smaller than their successors, in order of their first `depth` bytes at least.

    Each is named by the bytes up to the next such suffix; names are then doubled over the
    sequence of these suffixes alone.
    """
    at = np.flatnonzero(small)
    m = len(at)
    if m < 2:
        return at
    nxt = np.append(at[1:], len(text))
    length = np.minimum(nxt - at, 6)  # bytes in a first name; the rest of a long one is refined below
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    kind = np.concatenate((small, np.zeros(8, bool)))
    key = np.zeros(m, np.uint64)
    for j in range(7):  # a byte and its type, 9 bits each; the type settles where one name ends first
        used = j <= length
        key = (key << np.uint64(9)) | np.where(used, padded[at + j] * np.uint64(2) + kind[at + j], 0).astype(np.uint64)
    known, rank = np.unique(key, return_inverse=True)
    rank = rank.astype(np.int64)
    long = nxt - at > 6
    if long.any():  # names of more than seven bytes, compared whole
        tails = [text[a : b + 1].tobytes() for a, b in zip(at[long], np.minimum(nxt[long], len(text) - 1))]
        order = {t: i for i, t in enumerate(sorted(set(tails)))}
        sub = np.zeros(m, np.int64)
        sub[long] = [order[t] for t in tails]
        _, rank = np.unique(rank * (len(order) + 1) + sub, return_inverse=True)
        rank = rank.astype(np.int64)
    # doubling over the sequence of these suffixes; each step is one byte at least
    size = 1
    while size < depth:
        shifted = np.zeros(m, np.int64)
        shifted[:-size] = rank[size:] + 1
        known, new = np.unique(rank * (m + 2) + shifted, return_inverse=True)
        size *= 2
        done = len(known) == m or (at[min(size, m - 1) :] - at[: m - min(size, m - 1)]).min(initial=depth) >= depth
        rank = new.astype(np.int64)
        if done or size >= m:
            break
    return at[np.argsort(rank, kind="stable")]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` bytes at least, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. The buckets of first bytes are
    then scanned in ascending order: each suffix found puts its predecessor, if that is larger, at
    the next free place of the predecessor's bucket.
    """
    n = len(text)
    small = _below_successor(text)
    direct = _sort_direct(text, small, depth)
    counts = np.bincount(text, minlength=256)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n_small = np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    free = starts[:-1].copy()
    sorted_first = np.concatenate(([0], np.cumsum(n_small)))
    for c in range(256):  # the directly sorted fill the ends of their buckets
        out[starts[c + 1] - n_small[c] : starts[c + 1]] = direct[sorted_first[c] : sorted_first[c + 1]]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        into, begin, many = np.unique(first, return_index=True, return_counts=True)
        for b, i, m in zip(into, begin, many):
            out[free[b] : free[b] + m] = before[i : i + m]
            free[b] += m

    induce(np.array([n]))  # the empty suffix comes first
    for c in range(256):
        done, end = starts[c], starts[c + 1] - n_small[c]
        while done < end:  # runs of one byte induce into their own bucket
            upto = free[c]
            if upto == done:
                break
            induce(out[done:upto])
            done = upto
        if n_small[c]:
            induce(out[end : starts[c + 1]])
    return out


def repeated_windows(shard: dict, window: int) -> pa.RecordBatch:
    """Runs (first, last) of starts, in each context, of windows found at two places or more.

    All windows of a context that was merged from several are; so are those of one that is alone with
    its anchor, which occurs twice. The others' contexts are sorted.
    """
    chosen = unlike(shard)
    wins = shard["wins"].astype(np.int32)
    firsts, lasts = [np.zeros(1, np.int32)] * len(wins), [np.array([w - 1], np.int32) for w in wins]
    if chosen.any():
        for i, (a, b) in zip(np.flatnonzero(chosen), _sorted_runs(part(shard, chosen), window)):
            firsts[i], lasts[i] = a, b
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in firsts]))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (firsts, lasts)]
    return pa.RecordBatch.from_arrays([pa.array(shard["ah"]), pa.array(shard["ch"]), *lists], ["ah", "ch", "lo", "hi"])


def _sorted_runs(shard: dict, window: int):
    """The runs of each context, from the suffix array of all of them."""
    sizes = np.fromiter(map(len, shard["body"]), np.int64, len(shard["body"]))
    text = np.frombuffer(b"".join(b + bytes([END]) for b in shard["body"]), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(text, window)
    # common prefixes of adjacent suffixes, as far as the window
    rolling = Rolling(BYTE_BASE)
    prefix = rolling.prefix(BYTE_VALUES[text])
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    room = np.arange(len(text)) + window <= begins[owner] + sizes[owner]
    valid = order[room[order]]
    whole = rolling.ranges(prefix, valid, valid + window)
    same = whole[1:] == whole[:-1]
    repeated = np.zeros(len(text), bool)
    repeated[valid[1:][same]] = True
    repeated[valid[:-1][same]] = True
    repeated |= (shard["n"][owner] > 1) & room
    edge = np.diff(np.concatenate(([0], (repeated & room).astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    whose = owner[first]  # a run never crosses a context: its last places have no room
    at = np.searchsorted(whose, np.arange(len(sizes) + 1))
    first, last = first - begins[whose], last - begins[whose]
    return [(first[a:b], last[a:b]) for a, b in zip(at[:-1], at[1:])]


def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """_d, _t and the runs (first, last) of starts of windows that also start elsewhere."""
    found = occurrences(docs, window, k, words=False, keep=True)
    cold, hot, used = contexts(docs, found, window, words=False)
    runs = by_shard(cold, lambda shard: repeated_windows(shard, window), "ah long, ch long, lo array<int>, hi array<int>")
    if hot is not None:  # each window alone with its key: it occurs as often as its equals together
        twice = write(hot.groupBy("wh").agg(F.sum("n").alias("c")).where("c > 1").select("wh"))
        lists = hot.select("ah", "ch", "s", "wh").join(twice.hint("merge"), "wh").groupBy("ah", "ch").agg(F.sort_array(F.collect_list("s")).alias("ss"))
        begins = F.filter("ss", lambda x, i: (i == 0) | (F.get("ss", i - 1) != x - 1))
        ends = F.filter("ss", lambda x, i: (i == F.size("ss") - 1) | (F.get("ss", i + 1) != x + 1))
        runs = runs.unionByName(lists.select("ah", "ch", begins.alias("lo"), ends.alias("hi")))
        used.append(twice)
    runs = write(runs)
    for table in used:
        drop(table)
    shift = lambda c: F.transform(c, lambda x: x + F.col("pos"))
    joined = found.join(runs.where(F.size("lo") > 0), ["ah", "ch"]).select("d", "t", shift("lo").alias("lo"), shift("hi").alias("hi"))
    spans = write(joined.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.flatten(F.collect_list("lo")).alias("_lo"), F.flatten(F.collect_list("hi")).alias("_hi")))
    drop(found)
    drop(runs)
    return spans


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, texts: bool = False) -> DataFrame:
    """Remove each byte inside a `window`-byte string that also starts anywhere else.

    Contexts of repeated anchors are dealt to shards; each shard's distinct contexts are sorted by a
    two-stage suffix array, and equal windows are found as adjacent suffixes with common prefixes of
    `window` bytes (compared by 64-bit fingerprints). Overlaps within a text count; windows never
    cross texts and are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for each row of
    docs. With texts=True: docs with the bytes cut out of text (a character that is cut in two goes
    as a whole), in all columns.

    Ids are whole numbers of any width; null ids stay. Null text is empty. Rows of one id and equal texts are two places, as any other equal texts are.
    Texts shorter than the window lose nothing; an empty table gives no rows.
    """
    rows = sealed(docs) if texts else docs.select("doc_id", "text")
    joined = keyed(rows).join(repeated_runs(docs, window, k), ["_d", "_t"], "left").drop("_d", "_t")
    names = rows.columns

    def kept(batches):
        for batch, data, off in text_slices(batches):
            masks = []
            for r, (lo, hi) in enumerate(zip(batch.column("_lo"), batch.column("_hi"))):
                if not lo.is_valid:
                    masks.append(None)
                    continue
                delta = np.zeros(off[r + 1] - off[r] + 1, np.int64)
                np.add.at(delta, np.array(lo.as_py()), 1)
                np.add.at(delta, np.array(hi.as_py()) + window, -1)
                masks.append(np.cumsum(delta[:-1]) == 0)
            yield batch, data, off, masks

    def digest(batches):
        for batch, data, off, masks in kept(batches):
            rows = []
            for r, mask in enumerate(masks):
                own = data[off[r] : off[r + 1]]
                left = own if mask is None else own[mask]
                spans = 0 if mask is None else int((np.diff(np.concatenate(([1], mask.astype(np.int8)))) == -1).sum())
                rows.append((len(own), len(own) - len(left), spans, hashlib.sha256(left.tobytes()).hexdigest()))
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def cleaned(batches):
        for batch, data, off, masks in kept(batches):
            out = batch.column("text").to_pylist()
            for r, mask in enumerate(masks):
                if mask is not None:
                    out[r] = data[off[r] : off[r + 1]][mask].tobytes().decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column("text").type) if c == "text" else batch.column(c) for c in names], names)

    if texts:
        return unsealed(joined.mapInArrow(cleaned, rows.schema), docs)
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return joined.mapInArrow(digest, T.StructType([docs.schema["doc_id"], *longs, T.StructField("kept_sha256", T.StringType())]))
