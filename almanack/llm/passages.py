"""Repeated windows of symbols found by content-chosen anchors, for exact substring matching.

A window is W consecutive symbols (words or bytes) of one text. Its anchor is the leftmost k-gram of
least hash in it, so equal windows have equal anchors. The windows of one anchor are adjacent; the
stretch they cover, at most 2W - k symbols, is that anchor's context. Contexts whose anchor occurs
once are dropped; equal contexts are merged before any text moves; the rest are dealt by anchor to
shards, each of which is indexed and searched by the operator's own method. An anchor with very many
distinct contexts, such as that of a common line, would fill one shard: its windows are dealt one by
one instead, each by a hash of all its symbols, and equal ones are summed before they meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from almanack.llm.session import drop, write
from almanack.llm.textkit import BYTE_BASE, BYTE_VALUES, SPACES, U64, WORD_BASE, Rolling, WordHasher, row_starts, text_slices, word_bounds

#: Bytes of contexts indexed together; a shard grows beyond it only to hold one anchor's contexts.
SHARD_BYTES = 3 << 20
#: Distinct contexts of an anchor that one shard takes; the windows of larger anchors are dealt one by one.
HOT_CONTEXTS = 5_000
_LAST = U64(0xFFFFFFFFFFFFFFFF)


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w adjacent values; len(a) - w + 1 values."""
    size = 1
    while size * 2 <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


class Anchors:
    """Finds the anchors of W-symbol windows."""

    def __init__(self, window: int, k: int, words: bool):
        self.window, self.k, self.words = window, k, words
        self.rolling = Rolling(WORD_BASE if words else BYTE_BASE)
        self.hasher = WordHasher() if words else None

    def symbols(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the symbols and the first symbol of each row."""
        if not self.words:
            return BYTE_VALUES[data], off
        starts, ends, rows = word_bounds(data, off, SPACES)
        return self.hasher.word_hashes(data, starts, ends), row_starts(rows, len(off) - 1)

    def find(self, data: np.ndarray, off: np.ndarray):
        """(row, first window's start in the row, windows, anchor hash, context hash) of every anchor."""
        values, first = self.symbols(data, off)
        n, width, k = len(values), self.window, self.k
        w = width - k + 1
        if n < width:
            z = np.zeros(0, np.int64)
            return z, z, z, z, z
        prefix = self.rolling.prefix(values)
        at = np.arange(n - k + 1)
        g = self.rolling.ranges(prefix, at, at + k)
        # row_of only where needed: the last start at which a k-gram or window stays in its row
        sizes = np.diff(first)
        whole = np.repeat(first[1:], sizes)  # end of the row of each symbol
        g[at + k > whole[at]] = _LAST
        s = np.arange(n - width + 1)
        least = _slide(g, w, np.minimum)
        least[s + width > whole[s]] = 0
        pad = np.zeros(w - 1, U64)
        reach = _slide(np.concatenate((pad, least, pad)), w, np.maximum)
        p = np.flatnonzero((reach == g) & (g != _LAST))
        row = np.searchsorted(first, p, "right") - 1
        low, high = np.maximum(p - w + 1, first[row]), np.minimum(p, first[row + 1] - width)
        mine = g[p]
        left, right = np.arange(len(p)), np.arange(len(p))
        for d in range(1, w):  # nearest k-gram before that is no larger, and after that is smaller
            left = left[p[left] - d >= low[left]]
            found = g[p[left] - d] <= mine[left]
            low[left[found]] = p[left[found]] - d + 1
            left = left[~found]
            right = right[p[right] + d < np.minimum(high[right] + w, len(g))]
            found = g[p[right] + d] < mine[right]
            high[right[found]] = p[right[found]] + d - w
            right = right[~found]
            if not len(left) and not len(right):
                break
        good = low <= high
        p, row, low, high, mine = p[good], row[good], low[good], high[good], mine[good]
        context = self.rolling.ranges(prefix, low, high + width)
        return row, low - first[row], high - low + 1, mine.view(np.int64), context.view(np.int64)


def sealed(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text and rest, a struct of all other columns, whose names can't clash with any."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {name: docs.columns.index(name) for name in ("doc_id", "text")}
    rest = [f"c{i}" for i in range(len(docs.columns)) if i not in at.values()]
    return plain.select(*(F.col(f"c{i}").alias(name) for name, i in at.items()), F.struct(F.lit(0).alias("none"), *rest).alias("rest"))


def unsealed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, under their names and in their order."""
    own = ("doc_id", "text")
    found = [F.col(c) if c in own and docs.columns.index(c) == i else F.col(f"rest.c{i}") for i, c in enumerate(docs.columns)]
    return rows.select(*(c.alias(f"c{i}") for i, c in enumerate(found))).toDF(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: _d, the id (null: least long), and _t, a hash of the text for rows that share an id."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}: number the rows first")
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_t": F.shiftright(F.xxhash64(F.col("text")), 32).cast("int")})


_ANCHOR = "ah long, ch long, d long, t int, pos int, wins int"


def occurrences(docs: DataFrame, window: int, k: int, words: bool, keep: bool) -> DataFrame:
    """Anchors that occur at least twice: ah, ch, d, t, pos, wins. Written to the shared folder.

    Anchor counts are summed before their shuffle. Anchors that occur twice are written, so that both
    sides of the join on the anchor are plain tables and Spark can split it where one is frequent.
    keep: write all anchors once instead of finding them again for the join, which pays where they
    are few.
    """

    def run(batches):
        finder = Anchors(window, k, words)
        for batch, data, off in text_slices(batches):
            row, pos, wins, ah, ch = finder.find(data, off)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ah), pa.array(ch), batch.column("_d").take(at), batch.column("_t").take(at), pa.array(pos.astype(np.int32)), pa.array(wins.astype(np.int32))],
                ["ah", "ch", "d", "t", "pos", "wins"],
            )

    texts = keyed(docs.select("doc_id", "text")).where(F.col("text").isNotNull()).select("_d", "_t", "text")
    find = lambda: texts.mapInArrow(run, _ANCHOR)
    found = write(find()) if keep else find()
    twice = write(found.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah"))
    repeated = write((found if keep else find()).join(twice.hint("merge"), "ah"))
    drop(twice)
    if keep:
        drop(found)
    return repeated


def _by_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Documents that hold the first occurrence of a context, with the list cs of those."""
    wanted = picked.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("ah", "ch", "n", "pos", "wins", "hot")).alias("cs"))
    return keyed(docs.select("doc_id", "text")).select("_d", "_t", "text").join(wanted, ["_d", "_t"])


def contexts(docs: DataFrame, found: DataFrame, window: int, words: bool) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(distinct contexts with their text, windows of hot anchors or None, tables to drop after use).

    Contexts are ah, ch, n (occurrences), d, pos (of the first), wins, body, with words joined by one space; the text of
    each comes from its first occurrence's document. Windows are ah, ch, n, d, pos, s (the place in the context) and wh, a
    hash of the window. Both come from one pass over the texts.
    """
    merged = found.groupBy("ah", "ch").agg(F.min(F.struct("d", "pos", "t", "wins")).alias("x"), F.count("*").alias("n"))
    distinct = write(merged.select("ah", "ch", "n", "x.d", "x.t", "x.pos", "x.wins"))
    large = write(distinct.groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > HOT_CONTEXTS).select("ah", F.lit(True).alias("hot")))
    any_hot = large.limit(1).count() > 0
    picked = distinct.join(large.hint("merge"), "ah", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else distinct.withColumn("hot", F.lit(False))

    def bodies(batch, data, off, flat, row):
        raw = data.tobytes()
        low = flat["pos"].to_numpy().astype(np.int64)
        high = low + flat["wins"].to_numpy() + window - 1
        out, last = [], -1
        for r, a, b in zip(row, low, high):
            if words:
                if r != last:
                    parts, last = raw[off[r] : off[r + 1]].split(), r
                out.append(b" ".join(parts[a:b]))
            else:
                out.append(raw[off[r] + a : off[r] + b])
        return {**{c: flat[c] for c in ("ah", "ch", "n", "pos", "wins")}, "d": batch.column("_d").take(pa.array(row)), "body": pa.array(out, pa.binary())}

    def windows(batch, data, off, flat, row, finder):
        values, first = finder.symbols(data, off)
        prefix = finder.rolling.prefix(values)
        wins = flat["wins"].to_numpy().astype(np.int64)
        each = np.repeat(np.arange(len(wins)), wins)
        s = np.arange(len(each)) - np.repeat(np.cumsum(wins) - wins, wins)
        start = flat["pos"].to_numpy()[each] + s
        at = first[row[each]] + start
        wh = finder.rolling.ranges(prefix, at, at + window).view(np.int64)
        take = pa.array(each)
        return {
            **{c: flat[c].take(take) for c in ("ah", "ch", "n")}, "pos": pa.array(start.astype(np.int32)), "s": pa.array(s.astype(np.int32)),
            "wh": pa.array(wh), "d": batch.column("_d").take(pa.array(row[each])),
        }

    kinds = {"ah": pa.int64(), "ch": pa.int64(), "n": pa.int64(), "d": pa.int64(), "pos": pa.int32(), "wins": pa.int32(), "body": pa.binary()}
    if any_hot:
        kinds |= {"s": pa.int32(), "wh": pa.int64()}

    def run(batches):
        finder = Anchors(window, 1, words)
        for batch, data, off in text_slices(batches):
            lists = batch.column("cs")
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hot = flat["hot"].to_numpy(zero_copy_only=False)
            parts = []
            if not hot.all():
                parts.append(bodies(batch, data, off, flat.filter(pa.array(~hot)), row[~hot]))
            if hot.any():
                parts.append(windows(batch, data, off, flat.filter(pa.array(hot)), row[hot], finder))
            for part in parts:
                n = len(part["ah"])
                yield pa.RecordBatch.from_arrays([part[c] if c in part else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))

    found_rows = _by_text(docs, picked).mapInArrow(run, "ah long, ch long, n long, d long, pos int, wins int, body binary" + (", s int, wh long" if any_hot else ""))
    if not any_hot:
        return found_rows, None, [distinct, large]
    both = write(found_rows)
    return both.where("wh IS NULL").drop("s", "wh"), both.where("wh IS NOT NULL").drop("body", "wins"), [distinct, large, both]


def unlike(shard: dict) -> np.ndarray:
    """Contexts whose anchor has other contexts too; all windows of the rest occur in equal contexts only."""
    _, at, n = np.unique(shard["ah"], return_inverse=True, return_counts=True)
    return n[at] > 1


def part(shard: dict, chosen: np.ndarray) -> dict:
    return {c: [b for b, x in zip(v, chosen) if x] if c == "body" else v[chosen] for c, v in shard.items()}


def by_shard(rows: DataFrame, solve: Callable[[dict], pa.RecordBatch], schema: str, limit: int = SHARD_BYTES) -> DataFrame:
    """solve() over shards of whole anchors, of about `limit` bytes of contexts each.

    solve gets columns ah, ch, n, d, pos, wins as arrays and body as a list of bytes, every (ah, ch) once.
    """

    def run(batches):
        held, size = [], 0

        def solved(batch: pa.Table) -> pa.RecordBatch:
            columns = {c: batch.column(c).to_numpy() for c in ("ah", "ch", "n", "d", "pos", "wins")}
            new = np.ones(batch.num_rows, bool)
            new[1:] = (columns["ah"][1:] != columns["ah"][:-1]) | (columns["ch"][1:] != columns["ch"][:-1])
            bodies = batch.column("body").to_pylist()
            return solve({c: v[new] for c, v in columns.items()} | {"body": [b for b, x in zip(bodies, new) if x]})

        for big in batches:
            for batch, _, off in text_slices([big], "body", limit // 4):
                held.append(batch)
                size += int(off[-1])
                if size >= limit:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ah = table.column("ah").to_numpy()
                    end = int(np.searchsorted(ah, ah[-1]))  # the last anchor may go on in the next batch
                    if end:
                        yield solved(table.slice(0, end))
                        rest = table.slice(end).combine_chunks()
                        held, size = rest.to_batches(), rest.nbytes
        if held:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("ah").sortWithinPartitions("ah", "ch").mapInArrow(run, schema)
