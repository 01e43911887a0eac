"""Numeric band join: sorted blocks with zone maps, tiles of overlapping blocks, bounded top-k and sums.

Points are first summed by their value, so the blocks of either side hold distinct sorted values and a
value that a third of all rows share is one entry of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.session import drop, write

#: Rows that a task sorts at once, and values in a block.
CHUNK_ROWS, BLOCK = 500_000, 256
#: Values beyond this are not exact as cents in a double and don't take part.
LIMIT = 1 << 52

_POINT = "value long, n long, w long, a array<long>, b array<long>, owner array<long>"
_BLOCK = "lo long, hi long, level int, reach_lo long, reach_hi long, value array<long>, n array<long>, w array<long>, size array<int>, a array<long>, b array<long>, owner array<long>"
_PART = "value long, n long, gap_sum long, w long, gap array<long>, near array<long>, a array<long>, b array<long>, owner array<long>"


class Band:
    """|u - p| <= width, or den * |u - p| <= num * min(u, p)."""

    def __init__(self, width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den

    def below(self, p):
        """The least u that pairs with p."""
        return np.minimum(p - self.width, -(-self.den * np.maximum(p, 0) // (self.den + self.num)) + np.minimum(p, 0))

    def above(self, p):
        """The greatest u that pairs with p."""
        return p + np.maximum(self.width, self.num * np.maximum(p, 0) // self.den)

    def column(self, u: str, p: str):
        return F.expr(f"abs({u} - {p}) <= {self.width} OR {self.den} * abs({u} - {p}) <= {self.num} * least({u}, {p})")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _rank(starts: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def first_of(group: np.ndarray, order: list[np.ndarray], owner: np.ndarray, k: int) -> np.ndarray:
    """Indices, in order, of at most k rows of an owner and 2k rows of a group: whichever one owner is left
    out, the first k of the others are among them. Bounded, and first_of of parts is first_of of the whole."""
    at = np.lexsort((owner, *order[::-1], group))
    g, o = group[at], owner[at]
    by = np.lexsort((o, g))  # stable: rows of an owner stay in order
    rank = np.empty(len(at), np.int64)
    rank[by] = _rank(_starts(g[by], o[by]), len(at))
    at = at[rank < k]
    return at[_rank(_starts(group[at]), len(at)) < 2 * k]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the length of each list."""
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sum_points(k: int):
    """Rows to one row for each value in a chunk."""

    def run(batches):
        for batch in _chunks(batches, CHUNK_ROWS):
            value, weight, owner, a, b = (_column(batch, c) for c in ("value", "weight", "owner", "a", "b"))
            at = np.argsort(value, kind="stable")
            starts = _starts(value[at])
            kept = first_of(value, [a, b], owner, k)
            sizes = np.diff(np.append(_starts(value[kept]), len(kept)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[at][starts]), pa.array(np.diff(np.append(starts, len(at)))), pa.array(np.add.reduceat(weight[at], starts)), *(_lists(x[kept], sizes) for x in (a, b, owner))],
                ["value", "n", "w", "a", "b", "owner"],
            )

    return run


def _blocks(k: int, band: Band | None):
    """Sorted rows of _POINT, merged by value, to blocks; with band (the probes' side) reach is what its values pair with."""

    def block(value, n, w, sizes, a, b, owner):
        lo, hi = int(value[0]), int(value[-1])
        reach = (int(band.below(lo)), int(band.above(hi))) if band else (lo, hi)
        level = (reach[1] - reach[0]).bit_length()
        return [lo, hi, level, *reach, value, n, w, sizes, a, b, owner]

    def run(batches):
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        rest: list | None = None

        def cut(parts, least):
            value, n, w, sizes, a, b, owner = parts
            done, ends = [], np.append(0, np.cumsum(sizes))
            lo = 0
            while len(value) - lo >= least:
                hi = min(lo + BLOCK, len(value))
                c = slice(ends[lo], ends[hi])
                done.append(block(value[lo:hi], n[lo:hi], w[lo:hi], sizes[lo:hi], a[c], b[c], owner[c]))
                lo = hi
            c = slice(ends[lo], None)
            return done, [value[lo:], n[lo:], w[lo:], sizes[lo:], a[c], b[c], owner[c]]

        def rows(done):
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            value, n, w = (_column(batch, c) for c in ("value", "n", "w"))
            (a, sizes), (b, _), (owner, _) = (_flat(batch, c) for c in ("a", "b", "owner"))
            parts = [value, n, w, sizes, a, b, owner]
            if rest is not None:
                parts = [np.concatenate(x) for x in zip(rest, parts)]
            value, n, w, sizes, a, b, owner = parts
            starts, of = _starts(value), np.repeat(value, sizes)
            kept = first_of(of, [a, b], owner, k) if len(of) else np.zeros(0, np.int64)
            count = np.zeros(len(starts), np.int64)
            np.add.at(count, np.searchsorted(value[starts], of[kept]), 1)
            merged = [value[starts], np.add.reduceat(n, starts), np.add.reduceat(w, starts), count, a[kept], b[kept], owner[kept]]
            done, rest = cut(merged, BLOCK + 1)  # the last value may go on in the next batch
            if done:
                yield rows(done)
        if rest is not None:
            done, _ = cut(rest, 1)
            yield rows(done)

    return run


def _tiles(k: int, band: Band):
    """One tile for each pair of blocks: all sums by comparison, then the nearest 2k candidates of each probe value."""

    def tile(p, value, n, w, sizes, a, b, owner):
        ends = np.append(0, np.cumsum(sizes))
        gap = np.abs(value[None, :] - p[:, None])
        inside = (gap <= band.width) | (band.den * gap <= band.num * np.minimum(value[None, :], p[:, None]))
        total = np.stack([inside @ n, (np.where(inside, gap, 0) * n).sum(1), inside @ w], 1)
        rank = np.where(inside, 2 * gap + (value[None, :] > p[:, None]), np.iinfo(np.int64).max)
        entries = inside.sum(1)
        out = [np.zeros(0, np.int64)] * 6
        todo, width = np.flatnonzero(entries), 4
        while len(todo):  # nearest entries until each probe value has what it needs; seldom more than one round
            m = min(width, rank.shape[1])
            near = np.argpartition(rank[todo], m - 1, axis=1)[:, :m] if m < rank.shape[1] else np.tile(np.arange(m), (len(todo), 1))
            row, col = np.repeat(todo, m), near.ravel()
            ok = inside[row, col]
            row, col = row[ok], col[ok]
            size = sizes[col]
            take = np.repeat(ends[col] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            row, col = np.repeat(row, size), np.repeat(col, size)
            kept = first_of(row, [gap[row, col], value[col], a[take], b[take]], owner[take], k)
            row, col, take = row[kept], col[kept], take[kept]
            full = (np.bincount(row, minlength=len(p)) >= 2 * k) | (entries <= m)
            use = full[row]
            out = [np.concatenate([x, y[use]]) for x, y in zip(out, (row, gap[row, col], value[col], a[take], b[take], owner[take]))]
            todo, width = todo[~full[todo]], width * 4
        at = np.argsort(out[0], kind="stable")
        return total, np.bincount(out[0], minlength=len(p)), [x[at] for x in out[1:]]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                p = get("p")
                total, sizes, near = tile(p, *(get(c) for c in ("value", "n", "w", "size", "a", "b", "owner")))
                hit = total[:, 0] > 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(p[hit]), *(pa.array(total[hit, c]) for c in range(3)), *(_lists(x, sizes[hit]) for x in near)], [c.split()[0] for c in _PART.split(", ")])

    return run


def _merge_parts(k: int):
    """Rows of _PART sorted by value, from several tiles, to one row a value."""

    def run(batches):
        rest: list | None = None
        names = [c.split()[0] for c in _PART.split(", ")]

        def rows(parts):
            value, n, g, w, sizes, *near = parts
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (value, n, g, w)), *(_lists(x, sizes) for x in near)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            near = [_flat(batch, c) for c in names[4:]]
            parts = [*(_column(batch, c) for c in names[:4]), near[0][1], *(x for x, _ in near)]
            if rest is not None:
                parts = [np.concatenate(x) for x in zip(rest, parts)]
            value, n, g, w, sizes, gap, u, a, b, owner = parts
            starts, of = _starts(value), np.repeat(value, sizes)
            kept = first_of(of, [gap, u, a, b], owner, k)
            count = np.zeros(len(starts), np.int64)
            np.add.at(count, np.searchsorted(value[starts], of[kept]), 1)
            merged = [value[starts], *(np.add.reduceat(x, starts) for x in (n, g, w)), count, *(x[kept] for x in (gap, u, a, b, owner))]
            tail = int(count[-1])
            rest = [*(x[-1:] for x in merged[:5]), *(x[len(x) - tail :] for x in merged[5:])]
            if len(starts) > 1:
                yield rows([*(x[:-1] for x in merged[:5]), *(x[: len(x) - tail] for x in merged[5:])])
        if rest is not None:
            yield rows(rest)

    return run


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_lo, right_lo) of zone maps (lo, level, reach_lo, reach_hi) whose reaches overlap, each once.

    A reach of at most 2^level values lies in two cells of that size. A pair meets at the larger of its
    levels, in the cell where the overlap begins, so an equi-join on (level, cell) finds it; no block is
    held against all others. Levels are at most 64.
    """
    zones = [x.select(F.col("lo").alias(f"{s}_lo"), F.col("level").alias(f"{s}_level"), F.col("reach_lo").alias(f"{s}_from"), F.col("reach_hi").alias(f"{s}_to")) for s, x in (("left", left), ("right", right))]
    levels = sorted({r[0] for z in zones for r in z.select(z.columns[1]).distinct().collect()})
    at = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    spread = []
    for side, z in zip(("left", "right"), zones):
        level = F.col(f"{side}_level")
        z = z.withColumn("at", F.explode(F.array_remove(F.transform(at, lambda x: F.when(x >= level, x).otherwise(-1)), -1)))
        spread.append(z.withColumn("cell", F.explode(F.expr(f"sequence(shiftright({side}_from, at), shiftright({side}_to, at))"))))
    return (
        spread[0].join(spread[1], ["at", "cell"])
        .where("at = greatest(left_level, right_level) AND cell = shiftright(greatest(left_from, right_from), at) AND left_from <= right_to AND right_from <= left_to")
        .select("left_lo", "right_lo")
    )


def band_join(probes: DataFrame, points: DataFrame, width: int = 50, num: int = 5, den: int = 1000, k: int = 10) -> DataFrame:
    """Pair each probe (id, value) with every point (value, owner, a, b, weight) of another owner that is near it:
    |u - p| <= width or den * |u - p| <= num * min(u, p). All columns are long; a and b break ties.

    Returns id, value, n_pairs, gap_sum, weight_sum over all pairs, and nearest, the first k pairs by (gap,
    value, a, b, owner) as an array of structs. No pair is left out of a sum: what is bounded is the list.

    Points are summed by value in the tasks that read them, with at most 2k candidates a value; both sides
    are range-partitioned, sorted and cut into blocks of 256 distinct values; zone maps of blocks meet by
    equi-join; each pair of overlapping blocks is one tile of numpy comparisons; sums and candidates of a
    probe value are merged over its tiles. Pairs with a probe's own points are taken off by a join on the
    owner. Nothing is broadcast on purpose, and the driver sees the levels of blocks, 64 numbers at most.

    A probe without a value, or beyond 2^52 either way, and a point with a null value, owner or a pair with
    nothing; a null b comes first; a probe without an id has no own points. Repeated points count and take a
    place each; repeated probes get a row each. Empty tables: no pairs. Other columns are not read.
    """
    band = Band(width, num, den)
    none = F.lit(-(1 << 63))
    points = points.select("value", "owner", "a", F.coalesce("b", none).alias("b"), "weight").where(f"owner IS NOT NULL AND a IS NOT NULL AND abs(value) <= {LIMIT}")
    probes = probes.select("id", F.when(F.abs("value") <= LIMIT, F.col("value")).alias("value"))

    summed = write(points.mapInArrow(_sum_points(k), _POINT))
    lines = write(summed.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(_blocks(k, None), _BLOCK))
    drop(summed)
    empty = F.array().cast("array<long>")
    asked = probes.where("value IS NOT NULL").select("value").distinct()
    asked = asked.select("value", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), empty.alias("a"), empty.alias("b"), empty.alias("owner"))
    wanted = write(asked.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(_blocks(k, band), _BLOCK))

    tiles = (
        overlapping(wanted, lines)
        .join(wanted.select(F.col("lo").alias("left_lo"), F.col("value").alias("p")), "left_lo")
        .join(lines.select(F.col("lo").alias("right_lo"), "value", "n", "w", "size", "a", "b", "owner"), "right_lo")
        .select("p", "value", "n", "w", "size", "a", "b", "owner")
    )
    parts = tiles.mapInArrow(_tiles(k, band), _PART)
    merged = parts.repartition("value").sortWithinPartitions("value").mapInArrow(_merge_parts(k), _PART)
    found = merged.select("value", "n", "gap_sum", "w", F.arrays_zip("gap", F.col("near").alias("value"), "a", "b", "owner").alias("near"))

    own = (
        points.groupBy("owner", "value").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        .join(probes.where("id IS NOT NULL AND value IS NOT NULL").distinct().select(F.col("id").alias("owner"), F.col("value").alias("p")), "owner")
        .where(band.column("value", "p"))
        .groupBy("owner", "p").agg(F.sum("n").alias("own_n"), F.sum(F.expr("abs(value - p) * n")).alias("own_gap"), F.sum("w").alias("own_w"))
        .select(F.col("owner").alias("id"), F.col("p").alias("value"), "own_n", "own_gap", "own_w")
    )
    less = lambda x, y: F.coalesce(F.col(x), F.lit(0)) - F.coalesce(F.col(y), F.lit(0))
    others = F.filter("near", lambda x: F.col("id").isNull() | (x["owner"] != F.col("id")))
    clean = F.transform(F.slice(F.coalesce(others, F.array()), 1, k), lambda x: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), x["a"].alias("a"), F.nullif(x["b"], none).alias("b"), x["owner"].alias("owner")))
    return probes.join(own, ["id", "value"], "left").join(found, "value", "left").select(
        "id", "value", less("n", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("w", "own_w").alias("weight_sum"), clean.alias("nearest")
    )


def near_prices(items: DataFrame, lines: DataFrame, k: int = 10) -> DataFrame:
    """Each item's pairs with lines of other items at a near unit price, in cents: rank 1 to k, then sums over all.

    A price or amount that is null, not a number or beyond 2^52 cents, a quantity of 0, and a line null in
    sale_id or item_id never pair. An item without pairs is one row of rank 0.
    """
    cents = lambda x: F.when(F.abs(x.cast("double")) <= 4.0e13, F.floor(100 * x.cast("double") + 0.5))  # noqa: E731  NaN is greater
    unit = lines.select(
        F.col("item_id").cast("long").alias("owner"), F.col("sale_id").cast("long").alias("a0"), F.col("line_no").cast("long").alias("b"), cents(F.col("amount")).alias("c"), F.expr("nullif(cast(quantity AS long), 0)").alias("q"),
    ).withColumn("t", F.expr("CASE WHEN q < 0 THEN -2 * c - q ELSE 2 * c + q END")).withColumn("d", F.expr("2 * abs(q)"))
    points = unit.select(
        F.expr("(t - pmod(t, d)) div d").alias("value"), "owner", F.col("a0").alias("a"), "b",
        F.crc32(F.concat_ws(",", F.col("a0").cast("string"), F.coalesce(F.col("b").cast("string"), F.lit("")), F.col("owner").cast("string"))).alias("weight"),
    )
    probes = items.select(F.col("item_id").cast("long").alias("id"), cents(F.col("price")).alias("value"))
    found = band_join(probes, points, k=k)
    ranked = found.select("*", F.posexplode_outer("nearest"))
    return ranked.select(
        F.col("id").alias("item_id"), F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"),
        F.col("col.gap").alias("gap"), F.col("col.value").alias("u"), F.col("col.a").alias("sale_id"), F.col("col.b").alias("line_no"), F.col("col.owner").alias("line_item_id"),
        "n_pairs", "gap_sum", F.col("weight_sum").alias("lines_crc"),
    )
