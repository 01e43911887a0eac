"""Vectors: quantisation, exact neighbours, votes, centroids, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.session import keep

#: Rows of either side of the neighbour search that meet in one task.
BLOCK_ROWS = 8192


def quantise(v: Column) -> Column:
    """struct(scale, q): scale is the greatest magnitude over 127, q the values rounded half up."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    q = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + 0.5))).cast("int"))
    return F.struct(scale.alias("scale"), q.alias("q"))


def dequantise(c: Column) -> Column:
    return F.transform(c["q"], lambda x: x * c["scale"])


def normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def truncate(v: Column, dim: int) -> Column:
    """The first dim values, scaled to length 1 again."""
    return normalise(F.slice(v, 1, dim))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int):
    """(query, neighbour, sim) of the k nearest of a block, by parts of at most 16 MB of similarities.

    Rows are not sorted: the k-th greatest of the maxima of parts of a row is no more than its k-th similarity, and only what reaches it is ordered.
    """
    step, part = max(1, (2 << 20) // max(1, len(ids))), 32
    for lo in range(0, len(q), step):
        some = q_ids[lo : lo + step]
        sims = q[lo : lo + step] @ matrix.T
        sims[some[:, None] == ids[None, :]] = -np.inf
        whole = len(ids) // part * part
        if whole >= part * k:
            tops = np.nan_to_num(np.fmax.reduce(sims[:, :whole].reshape(len(sims), -1, part), axis=2), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            row, col = np.nonzero(sims >= np.partition(tops, -k, axis=1)[:, -k, None] - 2e-9)
        else:
            row, col = np.nonzero(~np.isnan(sims))
        order = np.lexsort((ids[col], -np.round(sims[row, col], 9), row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        found = sims[row, col]
        held = np.isfinite(found)
        yield some[row[held]], ids[col[held]], found[held]


def knn(queries: DataFrame, base: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, sim, rank): the k nearest of base (id, vector) to each query, by exact cosine, itself excluded.

    Queries and base are dealt into blocks of about block_rows rows by a hash of their ids; each pair of blocks meets in
    one task, which multiplies them and keeps k rows a query; a window merges them. Nothing passes the driver but the
    two counts, and no task holds more than two blocks.
    """
    n_q, n_b = (max(1, -(-d.count() // block_rows)) for d in (queries, base))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", "vector", block(n_q, 1).alias("_q"), every(n_b).alias("_b"))
    b = base.select(F.col("id").alias("other"), F.col("vector").alias("against"), every(n_q).alias("_q"), block(n_b, 2).alias("_b"))
    matrix = lambda c: np.stack(c.to_numpy()).astype(np.float64)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = list(_nearest(left["id"].to_numpy(), matrix(left["vector"]), right["other"].to_numpy(), matrix(right["against"]), k)) if len(left) and len(right) else []
        a, c, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"id": a, "neighbour": c, "sim": s})

    found = q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInPandas(meet, "id long, neighbour long, sim double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def update_neighbours(cached: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, sim, rank) of rows (id, vector) from cached lists (id, neighbour, sim) of an earlier state.

    Rows that are new, or that lost a neighbour, are compared with all; the others keep their lists and are compared with
    the new rows only. The result is that of knn over all rows.
    """
    cached = keep(cached.select("id", "neighbour", "sim"))  # read six times, and maybe the result of a search
    live = rows.select("id")
    gone = cached.join(live.select(F.col("id").alias("neighbour")), "neighbour", "left_anti").select("id").distinct()
    kept = cached.join(live, "id", "left_semi").join(gone, "id", "left_anti")
    known = kept.select("id").distinct()
    stale = rows.join(known, "id", "left_anti")
    new = rows.join(cached.select("id").distinct(), "id", "left_anti")
    fresh = knn(stale, rows, k, block_rows).select("id", "neighbour", "sim")
    near = knn(rows.join(known, "id", "left_semi"), new, k, block_rows).select("id", "neighbour", "sim")
    return merge_neighbours(kept.unionByName(near), fresh, k)


def merge_neighbours(cached: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """The k best of old and new neighbour rows (id, neighbour, sim), each neighbour once."""
    both = cached.select("id", "neighbour", "sim").unionByName(fresh.select("id", "neighbour", "sim")).groupBy("id", "neighbour").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "neighbour")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, score): weights max(0, sim)^3 of labelled neighbours, as shares; the best label of each id."""
    w = F.pow(F.greatest(F.lit(0.0), F.col("sim")), 3)
    votes = neighbours.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.sum(w).alias("w"))
    total = votes.groupBy("id").agg(F.sum("w").alias("total"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "label")
    best = votes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return best.join(total, "id").select("id", "label", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("score"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): mean vectors scaled to length 1; partial sums before the shuffle."""
    mean = rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, group).select(group, "dim", F.try_divide("m", "norm").alias("value"))


def spherical_kmeans(rows: DataFrame, k: int, rounds: int = 25, seed: int = 1, centres_only: bool = False) -> DataFrame | np.ndarray:
    """(id, cluster, sim) by cosine k-means, or the centres alone; centres, k vectors, are kept on the driver.

    Seeds are k-means++ choices over all rows, one pass a seed: the row of least -ln(u) / distance,
    u by a hash of its id, which draws in proportion to the distance. Each round sums vectors by
    cluster where they lie and stops when every centre moves by a cosine of 0.999999 or more.
    """
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vector").first()
    if first is None:
        if centres_only:
            return np.zeros((0, 1))
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("sim"))
    centres = unit(np.array(first.vector, np.float64))[None]

    def draw(c):
        def run(batches):
            best = None
            for pdf in batches:
                if not len(pdf):
                    continue
                v = unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
                far = np.maximum(0, 1 - (v @ c.T).max(1))
                key = np.where(far > 1e-12, -np.log(pdf["u"].to_numpy()) / np.maximum(far, 1e-12), np.inf)
                i = np.lexsort((pdf["id"].to_numpy(), key))[0]
                if np.isfinite(key[i]) and (best is None or (key[i], pdf["id"].iloc[i]) < best[:2]):
                    best = (key[i], pdf["id"].iloc[i], v[i])
            if best:
                yield pd.DataFrame({"key": [best[0]], "id": [best[1]], "v": [best[2]]})

        return run

    while len(centres) < k:
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(len(centres))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        row = rows.select("id", "vector", u.alias("u")).mapInPandas(draw(centres), f"key double, id {dict(rows.dtypes)['id']}, v array<double>").orderBy("key", "id").first()
        if row is None:  # every row lies on a centre
            break
        centres = np.vstack([centres, row.v])

    def assign(c):
        def run(batches):
            for pdf in batches:
                v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                s = v @ c.T
                yield pd.DataFrame({"id": pdf["id"], "cluster": s.argmax(1).astype("int32"), "sim": s.max(1)})

        return run

    def sums(c):
        def run(batches):
            total = np.zeros_like(c)
            for pdf in batches:
                v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                np.add.at(total, (v @ c.T).argmax(1), v)
            yield pd.DataFrame({"cluster": range(len(c)), "v": list(total)})

        return run

    for _ in range(rounds):
        parts = rows.select("vector").mapInPandas(sums(centres), "cluster int, v array<double>").select("cluster", F.posexplode("v").alias("d", "x"))
        new = np.zeros_like(centres)
        for r in parts.groupBy("cluster", "d").agg(F.sum("x").alias("x")).collect():  # k x dim numbers
            new[r.cluster, r.d] = r.x
        norm = np.linalg.norm(new, axis=1)
        new, old = new[norm > 0] / norm[norm > 0, None], centres[norm > 0]
        centres = new
        if ((new * old).sum(1) >= 0.999999).all():
            break
    if centres_only:
        return centres
    return rows.select("id", "vector").mapInPandas(assign(centres), f"id {dict(rows.dtypes)['id']}, cluster int, sim double")
