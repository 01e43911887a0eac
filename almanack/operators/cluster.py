"""Trees over vectors: choosing splits, building, ordering, placing and naming nodes, and labels by score.

Whole tables are split by passes over all rows; a node of at most LOCAL_ROWS rows is finished in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.operators.search import cosine
from almanack.operators.vectors import spherical_kmeans, unit
from almanack.session import keep

#: Rows of a node that one task splits to its leaves.
LOCAL_ROWS = 20_000

# in one task -------------------------------------------------------------------------------------------


def _seeds(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ choices by cosine distance."""
    chosen = [int(rng.integers(len(v)))]
    far = 1 - v @ v[chosen[0]]
    while len(chosen) < k:
        weight = np.maximum(far, 0)
        if weight.sum() <= 1e-12:
            break
        chosen.append(int(rng.choice(len(v), p=weight / weight.sum())))
        far = np.minimum(far, 1 - v @ v[chosen[-1]])
    return v[chosen]


def local_kmeans(v: np.ndarray, k: int, seed: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, centres) by cosine; empty groups are left out."""
    centres = _seeds(v, k, np.random.default_rng(seed))
    for _ in range(rounds):
        group = (v @ centres.T).argmax(1)
        kept = np.unique(group)
        new = unit(np.stack([v[group == g].sum(0) for g in kept]))
        done = len(kept) == len(centres) and ((new * centres).sum(1) >= 0.999999).all()
        centres = new
        if done:
            break
    group = (v @ centres.T).argmax(1)
    return group, centres


def silhouette(own: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """(nearest - own) over the larger, of cosine distances to a row's own centre and the nearest other."""
    return (nearest - own) / np.maximum(np.maximum(own, nearest), 1e-9)


def split_quality(v: np.ndarray, group: np.ndarray, centres: np.ndarray) -> float:
    if len(centres) < 2:
        return -1.0
    far = 1 - v @ centres.T
    own = far[np.arange(len(v)), group].copy()
    far[np.arange(len(v)), group] = np.inf
    return float(silhouette(own, far.min(1)).mean())


def choose_split(v: np.ndarray, most: int, seed: int, probe: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The split into 2 to `most` groups of best silhouette: short runs choose the number, a full one splits."""
    scores = [(split_quality(v, *local_kmeans(v, k, seed, probe)), -k) for k in range(2, most + 1)]
    return local_kmeans(v, -max(scores)[1], seed)


def local_tree(v: np.ndarray, path: str, leaf: int, branch: int, depth: int, seed: int) -> list[str]:
    """The path of each row: a node is a leaf at the last depth, or with at most 1.6 times `leaf` rows."""
    out = [path] * len(v)
    work = [(np.arange(len(v)), path)]
    while work:
        rows, at = work.pop()
        if at.count("/") >= depth or len(rows) <= 1.6 * leaf:
            continue
        group, centres = choose_split(v[rows], max(2, min(branch, len(rows) // leaf)), seed + 7919 * len(at))
        if len(np.unique(group)) < 2:
            continue
        for n, g in enumerate(np.unique(group)):
            here = rows[group == g]
            for r in here:
                out[r] = f"{at}/{n}"
            work.append((here, f"{at}/{n}"))
    return out


def shortest_order(v: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> list[int]:
    """An order of a few rows with the least sum of cosine distances between neighbours, and to what stands outside:
    exact up to 8 rows, else nearest first, improved by turning stretches round."""
    n = len(v)
    if n < 2:
        return list(range(n))
    d = 1 - v @ v.T
    begin = 1 - v @ left if left is not None else np.zeros(n)
    end = 1 - v @ right if right is not None else np.zeros(n)
    if n <= 8:
        best = {(1 << i, i): (begin[i], (i,)) for i in range(n)}
        for _ in range(n - 1):
            wider = {}
            for (seen, last), (cost, order) in best.items():
                for j in range(n):
                    if not seen >> j & 1:
                        key, found = (seen | 1 << j, j), (cost + d[last, j], (*order, j))
                        wider[key] = min(wider.get(key, found), found)
            best = wider
        return list(min((cost + end[last], order) for (_, last), (cost, order) in best.items())[1])
    cost = lambda o: begin[o[0]] + end[o[-1]] + sum(d[a, b] for a, b in pairwise(o))
    order = [int(np.argmin(begin if left is not None else -d.sum(1)))]
    while len(order) < n:
        rest = [j for j in range(n) if j not in order]
        order.append(min(rest, key=lambda j: (d[order[-1], j], j)))
    better = True
    while better:
        better = False
        for i in range(n - 1):
            for j in range(i + 1, n):
                turned = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if cost(turned) < cost(order) - 1e-12:
                    order, better = turned, True
    return order


def order_siblings(nodes: DataFrame, left: list[float] | None = None, right: list[float] | None = None) -> DataFrame:
    """(parent, place, node) of nodes (parent, node, vector): the few children of each parent by the shortest way through them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        order = shortest_order(v, *(None if x is None else np.array(x, np.float64) for x in (left, right)))
        return pd.DataFrame({"parent": pdf["parent"].iloc[0], "place": pd.array(range(len(order)), "Int32"), "node": pdf["node"].iloc[order].to_numpy()})

    kinds = dict(nodes.dtypes)
    return nodes.groupBy("parent").applyInPandas(run, f"parent {kinds['parent']}, place int, node {kinds['node']}")


# over whole tables --------------------------------------------------------------------------------------


def silhouette_score(rows: DataFrame, centres: np.ndarray) -> float:
    """The mean silhouette of rows (vector) by their nearest centres; sums where the rows lie."""

    def run(batches):
        total, n = 0.0, 0
        for pdf in batches:
            if len(pdf):
                far = np.sort(1 - unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64)) @ centres.T, axis=1)
                total, n = total + float(silhouette(far[:, 0], far[:, 1]).sum()), n + len(pdf)
        yield pd.DataFrame({"s": [total], "n": [n]})

    if len(centres) < 2:
        return -1.0
    found = rows.select("vector").mapInPandas(run, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return found.s / found.n if found.n else -1.0


def group_silhouettes(rows: DataFrame) -> DataFrame:
    """(group, silhouette): the mean silhouette of each group of rows (id, group, vector), by distances to the centres, of which there is one vector
    a group. Centres are summed where rows lie, and rows are judged in one pass."""
    from almanack.operators.vectors import centroids

    parts = centroids(rows, "group", "vector").groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v")).orderBy("group").collect()  # one row a group
    names, centres = [r["group"] for r in parts], np.array([r["v"] for r in parts], np.float64)
    place = {g: i for i, g in enumerate(names)}

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            far = 1 - np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ centres.T
            at = pdf["group"].map(place).to_numpy()
            own = far[np.arange(len(at)), at].copy()
            far[np.arange(len(at)), at] = np.inf
            s = silhouette(own, far.min(1)) if len(names) > 1 else np.full(len(at), -1.0)
            yield pd.DataFrame({"group": pdf["group"], "s": s}).groupby("group")["s"].agg(["sum", "count"]).reset_index().set_axis(["group", "s", "n"], axis=1)

    found = rows.where("group IS NOT NULL").select("group", "vector").mapInPandas(run, f"group {dict(rows.dtypes)['group']}, s double, n long")
    return found.groupBy("group").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def choose_k(rows: DataFrame, most: int, least: int = 2, seed: int = 1, probe: int = 8) -> int:
    """The number of groups of best silhouette, by short runs over all rows; of equals the least."""
    scores = [(silhouette_score(rows, spherical_kmeans(rows, k, probe, seed, centres_only=True)), -k) for k in range(least, most + 1)]
    return -max(scores)[1]


#: Rows that a task holds of a node at once, and rows of a node among which its first centres are drawn.
BLOCK_ROWS, SEED_ROWS = 4096, 512


def _node_blocks(frame: DataFrame) -> DataFrame:
    """(path, ids, m) of frame (id, vector, path): rows of a node in blocks of about BLOCK_ROWS, vectors of length 1 one after the other."""
    sizes = frame.groupBy("path").agg(F.count("*").alias("n"))
    dealt = frame.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS)))
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform("vector", lambda x: x.cast("double") / F.greatest(size, F.lit(1e-12)))
    both = F.sort_array(F.collect_list(F.struct("id", scaled.alias("v"))))
    packed = dealt.groupBy("path", "block").agg(both.alias("r"), F.max("n").alias("n"))
    return packed.select("path", "n", F.col("r.id").alias("ids"), F.flatten("r.v").alias("m"))


def _first_centres(frame: DataFrame, sizes: DataFrame, branch: int, leaf: int, seed: int) -> DataFrame:
    """(path, k, c, v): k-means++ choices for every k that a node may be split into, drawn among SEED_ROWS of its rows
    by the order of a hash. The choices for k are the first k of those for the largest."""
    drawn = Window.partitionBy("path").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    some = frame.join(sizes, "path").withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= SEED_ROWS).select("path", "n", "id", "vector")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        most = max(2, min(branch, int(pdf["n"].iloc[0]) // leaf))
        v = _seeds(unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64)), most, np.random.default_rng(seed))
        rows = [(pdf["path"].iloc[0], k, c, v[c].tolist()) for k in range(2, len(v) + 1) for c in range(k)]
        return pd.DataFrame(rows, columns=["path", "k", "c", "v"])

    return some.groupBy("path").applyInPandas(choose, "path string, k int, c int, v array<double>")


def _with_centres(blocks: DataFrame, centres: DataFrame, each, schema: str) -> DataFrame:
    """each(ids, rows, k, centres) of every block with the centres of its node, one call for each k; rows of schema after path and k.

    A node's centres are one row, so a block meets them by its path, in a join that Spark may split.
    """
    packed = centres.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "c", "v"))).alias("centres"))

    def run(batches):
        for pdf in batches:
            for path, ids, m, cs in zip(pdf["path"], pdf["ids"], pdf["m"], pdf["centres"]):
                rows = np.asarray(m, np.float64).reshape(len(ids), -1)
                ks = np.array([x["k"] for x in cs])
                v = np.stack([x["v"] for x in cs])
                for k in np.unique(ks):
                    out = each(ids, rows, v[ks == k])
                    out.insert(0, "path", path)
                    out.insert(1, "k", int(k))
                    yield out

    return blocks.join(packed, "path").select("path", "ids", "m", "centres").mapInPandas(run, f"path string, k int, {schema}")


def _moved(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres after one round: sums by nearest centre where the rows lie, then added up; those without rows go."""

    def sums(ids, rows, v):
        near = (rows @ v.T).argmax(1)
        total = np.zeros_like(v)
        np.add.at(total, near, rows)
        some = np.flatnonzero(np.bincount(near, minlength=len(v)))
        return pd.DataFrame({"c": some.astype("int32"), "v": list(total[some])})

    parts = _with_centres(blocks, centres, sums, "c int, v array<double>").select("path", "k", "c", F.posexplode("v").alias("d", "x"))
    added = parts.groupBy("path", "k", "c", "d").agg(F.sum("x").alias("x")).groupBy("path", "k", "c").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))
    added = added.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["x"] * x["x"]))).where("size > 0")
    ranked = added.withColumn("c", (F.row_number().over(Window.partitionBy("path", "k").orderBy("c")) - 1).cast("int"))
    return ranked.select("path", "k", "c", F.transform("v", lambda x: x["x"] / F.col("size")).alias("v"))


def split_level(frame: DataFrame, leaf: int, branch: int, seed: int, probe: int = 8, rounds: int = 25) -> DataFrame:
    """(id, path, c) of all rows of frame (id, vector, path), every node split at once into 2 to `branch` groups.

    A node's number of groups is that of best mean silhouette after `probe` rounds for each number; then its rounds go
    on until no centre moves. One pass over the rows does a round for all nodes and all numbers; centres, keyed (node,
    number, group), stay in tables, and the driver only learns how many have moved. A node of one group comes back as c = 0.
    """
    blocks = keep(_node_blocks(frame))
    sizes = frame.groupBy("path").agg(F.count("*").alias("n"))
    centres = keep(_first_centres(frame, sizes, branch, leaf, seed))
    for _ in range(probe):
        centres = keep(_moved(blocks, centres))

    def fit(ids, rows, v):
        if len(v) < 2:
            return pd.DataFrame({"s": [0.0], "n": [0]})
        far = np.sort(1 - rows @ v.T, axis=1)
        return pd.DataFrame({"s": [float(silhouette(far[:, 0], far[:, 1]).sum())], "n": [len(rows)]})

    quality = _with_centres(blocks, centres, fit, "s double, n long").groupBy("path", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    best = quality.groupBy("path").agg(F.max_by("k", F.struct(F.coalesce(F.round(F.try_divide("s", "n"), 9), F.lit(-1.0)), -F.col("k"))).alias("k"))
    centres = keep(centres.join(best, ["path", "k"]))
    for _ in range(rounds - probe):
        new = keep(_moved(blocks, centres))
        old = centres.select("path", "k", "c", F.col("v").alias("_v"))
        same = F.aggregate(F.zip_with("v", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) >= 0.999999
        still = new.join(old, ["path", "k", "c"]).where(~same).limit(1).count() == 0
        centres = new
        if still:
            break

    def assign(ids, rows, v):
        return pd.DataFrame({"id": ids, "c": (rows @ v.T).argmax(1).astype("int32")})

    found = _with_centres(blocks, centres, assign, f"id {dict(frame.dtypes)['id']}, c int")
    return found.select("id", "path", "c")


def cluster_tree(rows: DataFrame, leaf: int = 12, branch: int = 10, depth: int = 6, seed: int = 1, known: Column | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(id, path) of rows (id, vector): paths like r/0/2 from the root to a leaf.

    known: the first levels as a path expression, such as of a taxonomy; the tree grows below them. All nodes of more
    than local_rows rows are split level by level, by passes over all their rows that do every node of a level at once;
    the others are each finished by one task. A node is a leaf at the last depth, with at most 1.6 times `leaf` rows,
    or if its rows can't be told apart. Ids are whole and unique; vectors are not null. An empty table gives an empty tree.
    """
    kind = dict(rows.dtypes)["id"]
    deep = F.size(F.split("path", "/")) - 1
    frame = keep(rows.select("id", "vector", (F.lit("r") if known is None else known).alias("path"), F.lit(False).alias("whole")))
    for _ in range(depth):
        sizes = frame.where(~F.col("whole")).groupBy("path").agg(F.count("*").alias("n"))
        large = sizes.where((F.col("n") > local_rows) & (F.col("n") > 1.6 * leaf) & (deep < depth)).select("path")
        todo = keep(frame.join(large, "path", "left_semi"))
        if todo.isEmpty():
            break
        split = keep(split_level(todo.select("id", "vector", "path"), leaf, branch, seed))
        groups = split.groupBy("path").agg(F.max("c").alias("top"))
        split = split.join(groups, "path").select("id", F.when(F.col("top") > 0, F.concat_ws("/", "path", "c")).otherwise(F.col("path")).alias("_p"), (F.col("top") == 0).alias("_w"))
        frame = keep(frame.join(split, "id", "left").select("id", "vector", F.coalesce("_p", "path").alias("path"), F.coalesce("_w", "whole").alias("whole")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"id": pdf["id"], "path": local_tree(v, pdf["path"].iloc[0], leaf, branch, depth, seed)})

    small = frame.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") <= local_rows).select("path")
    local = frame.where(~F.col("whole")).join(small, "path", "left_semi").select("id", "vector", "path").groupBy("path").applyInPandas(grow, f"id {kind}, path string")
    return local.unionByName(frame.where("whole").unionByName(frame.where(~F.col("whole")).join(small, "path", "left_anti")).select("id", "path"))


def recluster(rows: DataFrame, ids: DataFrame, most: int = 2000, **how) -> DataFrame:
    """cluster_tree of the rows asked for, at most `most` of them: a view that is made while somebody waits."""
    chosen = rows.join(ids.select("id").orderBy("id").limit(most), "id", "left_semi")
    return cluster_tree(chosen, **how)


def principal_axis(rows: DataFrame, group: str, rounds: int = 24) -> DataFrame:
    """(id, projection) of rows (id, group, vector) on the first principal axis of their group, its greatest part positive.

    Sums and products of dimensions are taken where the rows lie; the axis comes from a matrix of the dimension alone.
    """
    kind, g = dict(rows.dtypes)["id"], dict(rows.dtypes)[group]

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group):
                v = np.stack(part["vector"].to_numpy()).astype(np.float64)
                n, s, m = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(v), s + v.sum(0), m + v.T @ v)
        yield pd.DataFrame([(k, n, s.tolist(), m.ravel().tolist()) for k, (n, s, m) in held.items()], columns=[group, "n", "s", "m"])

    def axis(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].sum(), np.sum(np.stack(pdf["s"].to_numpy()), axis=0)
        mean = s / n
        m = np.sum(np.stack(pdf["m"].to_numpy()), axis=0).reshape(len(s), -1) - n * np.outer(mean, mean)
        x = np.ones(len(s)) / np.sqrt(len(s)) + 1e-3 * np.arange(len(s))
        for _ in range(rounds):
            y = m @ x
            norm = np.linalg.norm(y)
            if norm < 1e-15:
                break
            x = y / norm
        x = x * np.sign(x[np.argmax(np.abs(x))])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "axis": [x.tolist()], "shift": [float(mean @ x)]})

    parts = rows.select(group, "vector").mapInPandas(sums, f"{group} {g}, n long, s array<double>, m array<double>")
    axes = parts.groupBy(group).applyInPandas(axis, f"{group} {g}, axis array<double>, shift double")
    return rows.select(F.col("id").cast(kind).alias("id"), group, "vector").join(axes, group).select("id", group, (cosine(F.col("vector"), F.col("axis")) - F.col("shift")).alias("projection"))


# places ---------------------------------------------------------------------------------------------------


def leaf_bands(leaves: DataFrame, power: float = 0.75, gutter: float = 0.6) -> DataFrame:
    """leaves (leaf, seq, n) with y0, y1 in [0, 1]: heights as n ** power + gutter, and inner0, inner1 without the gutter."""
    weight = F.pow("n", F.lit(power)) + gutter
    run = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    b = leaves.withColumn("_w", weight).withColumns({"_c": F.sum("_w").over(run), "_t": F.sum("_w").over(Window.partitionBy())})
    y0, y1 = (F.col("_c") - F.col("_w")) / F.col("_t"), F.col("_c") / F.col("_t")
    pad = gutter / 2 / F.col("_t")
    return b.select(*leaves.columns, y0.alias("y0"), y1.alias("y1"), (y0 + pad).alias("inner0"), (y1 - pad).alias("inner1"))


def leaf_flips(ends: DataFrame) -> DataFrame:
    """(leaf, flip) of leaves (leaf, seq, first, last: vectors of their ends): a leaf is turned round where its last row is
    nearer than its first to the end that the leaf before it shows.

    What a leaf does depends on the one before it in one of three ways: not at all, as that one does, or the
    opposite; so the answer is the last that depends on nothing, turned by the opposites since.
    """
    order = Window.orderBy("seq")
    before = {"pf": F.lag("first").over(order), "pl": F.lag("last").over(order)}
    turns = lambda p: cosine(F.col(p), F.col("last")) > cosine(F.col(p), F.col("first"))
    s = ends.withColumns(before).select("leaf", "seq", F.coalesce(turns("pl"), F.lit(False)).alias("as_is"), F.coalesce(turns("pf"), F.lit(False)).alias("turned"))
    s = s.withColumn("run", F.sum(F.when(F.col("as_is") == F.col("turned"), 1).otherwise(0)).over(order))
    inside = Window.partitionBy("run").orderBy("seq")
    base = F.first("as_is").over(inside).cast("int")
    opposite = F.when((F.col("as_is") != F.col("turned")) & F.col("as_is"), 1).otherwise(0)
    start = F.when(F.col("run") > 0, base).otherwise(0)
    return s.withColumn("_o", opposite).select("leaf", (F.pmod(start + F.sum("_o").over(inside), F.lit(2)) == 1).alias("flip"))


def rows_in_bands(rows: DataFrame, bands: DataFrame, flips: DataFrame) -> DataFrame:
    """(id, leaf, rank, y) of rows (id, leaf, projection): evenly spread over their leaf's band in its direction."""
    w = Window.partitionBy("leaf")
    p = rows.join(flips, "leaf")
    key = F.when(F.col("flip"), -F.col("projection")).otherwise(F.col("projection"))
    tie = F.when(F.col("flip"), -F.col("id")).otherwise(F.col("id"))
    r = p.withColumns({"rank": F.row_number().over(w.orderBy(key, tie)) - 1, "_n": F.count("*").over(w)})
    y = F.col("inner0") + F.when(F.col("_n") == 1, 0.5).otherwise((F.col("rank") + 0.5) / F.col("_n")) * (F.col("inner1") - F.col("inner0"))
    return r.join(bands.select("leaf", "inner0", "inner1"), "leaf").select("id", "leaf", "rank", y.alias("y"))


def place_in_tree(rows: DataFrame, nodes: DataFrame, start: Column | None = None, depth: int = 6) -> DataFrame:
    """(id, node) of rows (id, vector, ...) in a frozen tree of nodes (node, parent, centroid): from the root, or the node that
    `start` names, down to the nearest child each time."""
    root = nodes.where("parent IS NULL").select(F.col("node").alias("_root"))
    known = nodes.select(F.col("node").alias("_start"), F.lit(True).alias("_known"))
    at = rows.select("id", "vector", (F.lit(None).cast(dict(nodes.dtypes)["node"]) if start is None else start).alias("_start")).join(known, "_start", "left").join(F.broadcast(root))  # one row
    at = at.select("id", "vector", F.when(F.col("_known"), F.col("_start")).otherwise(F.col("_root")).alias("node"))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.collect_list(F.struct(F.col("node").alias("kid"), "centroid")).alias("kids"))
    for _ in range(depth):
        near = F.array_max(F.transform("kids", lambda k: F.struct(F.round(cosine(F.col("vector"), k["centroid"]), 9).alias("s"), (-k["kid"]).alias("kid"))))
        at = at.join(kids, "node", "left").select("id", "vector", F.coalesce(-near["kid"], F.col("node")).alias("node"))
    return at.select("id", "node")


def fill_gaps(rows: DataFrame) -> DataFrame:
    """(id, y) of rows (id, leaf, projection, y or null, inner0, inner1): newcomers of a leaf are spread evenly between the known
    places before and after them along its axis. The one after is the one before in the reverse order: a frame up to the
    end of a leaf would be read anew for each of its rows."""
    w = Window.partitionBy("leaf").orderBy("projection", "id")
    so_far = lambda order: order.rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = so_far(w), so_far(Window.partitionBy("leaf").orderBy(F.desc("projection"), F.desc("id")))
    r = rows.withColumns({
        "lo": F.coalesce(F.last("y", True).over(back), F.col("inner0")), "hi": F.coalesce(F.last("y", True).over(ahead), F.col("inner1")),
        "run": F.count("y").over(back), "new": F.col("y").isNull(),
    })
    inside = Window.partitionBy("leaf", "run", "new")
    k, n = F.row_number().over(inside.orderBy("projection", "id")), F.count("*").over(inside)
    return r.select("id", F.when(F.col("new"), F.col("lo") + (F.col("hi") - F.col("lo")) * k / (n + 1)).otherwise(F.col("y")).alias("y"))


# names ----------------------------------------------------------------------------------------------------


def without_parts(terms: Column, most: int) -> Column:
    """The first `most` of an ordered array of which none holds, or is held by, a better one."""

    def step(kept, t):
        clash = F.exists(kept, lambda k: F.contains(k, t) | F.contains(t, k))
        return F.when((F.size(kept) >= most) | clash, kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(terms, F.array().cast("array<string>"), step)


def node_terms(bags: DataFrame, most: int = 3, tried: int = 24) -> DataFrame:
    """(node, terms) from bags (node, term, weight): terms frequent inside and rare outside, without parts of better ones."""
    g = bags.groupBy("node", "term").agg(F.sum("weight").alias("w"))
    own = F.sum("w").over(Window.partitionBy("node"))
    everywhere = F.sum("w").over(Window.partitionBy("term"))
    total = F.broadcast(bags.agg(F.sum("weight").alias("total")))
    scored = g.withColumns({"own": own, "all": everywhere}).join(total).withColumn("score", F.col("w") / F.col("own") * F.log(1 + F.col("total") / F.col("all")))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round("score", 9)), "term"))).where(F.col("_r") <= tried)
    listed = best.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("ts"))
    return listed.select("node", without_parts(F.col("ts"), most).alias("terms"))


def exemplars(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(node, id): the row (id, node, vector) nearest to its node's centroid (node, centroid)."""
    sim = F.round(cosine(F.col("vector"), F.col("centroid")), 9)
    return rows.join(centroids, "node").groupBy("node").agg(F.max_by("id", F.struct(sim, -F.col("id"))).alias("id"))


def semantic_terms(nodes: DataFrame, terms: DataFrame, inside: DataFrame, n_rows: int, cover: float = 0.35, general: float = 0.05, tried: int = 24) -> DataFrame:
    """(node, lead): a term for each of sibling nodes (node, parent, n, centroid), each term to one node of a parent.

    A term (term, df, vector) scores by its cosine with the centroid, by the share of the node's rows that have it (inside:
    node, term, n), and by how near its frequency is to the node's size; ancestors' terms are left out beforehand. The best bid
    of all siblings wins its term, over and over, a round for each place in the lists. Terms are tried by their nodes' own rows.
    """
    met = inside.withColumnRenamed("n", "have").join(nodes, "node").join(terms, "term")
    near = F.abs(F.log(F.col("df") / float(n_rows)) - F.log(F.col("n") / float(n_rows)))
    score = F.round(cosine(F.col("centroid"), F.col("vector")) + cover * F.col("have") / F.col("n") - general * near, 9)
    bids = met.select("parent", "node", "term", score.alias("score")).withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "term"))).where(F.col("_r") <= tried)
    per = bids.groupBy("parent").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term", "node"))), lambda x: F.struct(x["node"].alias("node"), x["term"].alias("lead"))).alias("bs"))
    none = F.expr("filter(bs, x -> false)")

    def step(out, b):
        taken = F.exists(out, lambda o: (o["node"] == b["node"]) | (o["lead"] == b["lead"]))
        return F.when(taken, out).otherwise(F.concat(out, F.array(b)))

    return per.select("parent", F.explode(F.aggregate("bs", none, step)).alias("o")).select("o.node", "o.lead")


def distinct_labels(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent, label, terms) with siblings of one label told apart by their first term that no other sibling's label holds."""
    sib = nodes.groupBy("parent").agg(F.collect_list(F.struct(F.col("node").alias("n"), F.lower("label").alias("l"))).alias("ss"))
    j = nodes.join(sib, nodes.parent.eqNullSafe(sib.parent)).select(nodes["*"], "ss")
    others = F.transform(F.filter("ss", lambda s: s["n"] != F.col("node")), lambda s: s["l"])
    twin = F.array_contains(others, F.lower("label"))
    pick = F.get(F.filter(F.transform("terms", F.lower), lambda t: ~F.contains(F.lower("label"), t) & ~F.exists(others, lambda o: F.contains(o, t))), F.lit(0))
    return j.select("node", "parent", F.when(twin & pick.isNotNull(), F.concat(F.substring_index("label", " · ", 1), F.lit(" · "), F.initcap(pick))).otherwise(F.col("label")).alias("label"), "terms")


# labels by score --------------------------------------------------------------------------------------------


def primary_label(scores: Column) -> Column:
    """The subject of a map of scores by path: a region is none; a biography only where nothing else has 0.15; a
    catch-all (ending in *) gives way to a specific subject of its group with 0.15."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("t"))))
    subjects = F.filter(ranked, lambda x: ~F.startswith(x["t"], F.lit("Geography.Regions")))
    bio = lambda x: F.contains(x["t"], F.lit("Biography"))
    plain = F.filter(subjects, lambda x: ~bio(x))
    first = F.get(plain, F.lit(0))
    pick = F.when(first.isNotNull() & ((first["s"] <= -0.15) | (F.size(plain) == F.size(subjects))), first).otherwise(F.get(subjects, F.lit(0)))
    group = F.substring_index(pick["t"], ".", 1)
    specific = F.get(F.filter(plain, lambda x: ~F.endswith(x["t"], F.lit("*")) & F.startswith(x["t"], F.concat(group, F.lit("."))) & (x["s"] <= -0.15)), F.lit(0))
    best = F.when(F.endswith(pick["t"], F.lit("*")) & specific.isNotNull(), specific).otherwise(pick)
    return F.when(best.isNotNull(), F.struct(best["t"].alias("topic"), F.round(-best["s"], 3).alias("score")))


def region_label(scores: Column) -> Column:
    """The best region of 0.4 or more, a specific one before a catch-all."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("t"))))
    found = F.filter(ranked, lambda x: F.startswith(x["t"], F.lit("Geography.Regions")) & (x["s"] <= -0.4))
    one = F.coalesce(F.get(F.filter(found, lambda x: ~F.endswith(x["t"], F.lit("*"))), F.lit(0)), F.get(found, F.lit(0)))
    return F.regexp_replace(F.regexp_replace(one["t"], r"^Geography\.Regions\.", ""), r"\.", " › ")


def prior_scores(dataset: Column, priors: dict[str, dict[str, float]]) -> Column:
    """The scores that a data set alone gives."""
    out = F.lit(None).cast("map<string,double>")
    for name, scores in priors.items():
        out = F.when(dataset == name, F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])).otherwise(out)
    return out


def voted_scores(neighbours: DataFrame, scores: DataFrame, page: DataFrame) -> DataFrame:
    """(id, topic, score, best): means of neighbours' (id, neighbour, sim) scores (id, topic, score) by the cube of their similarity,
    0.6 of them mixed with 0.4 of the source page's (id, topic, score) where it has any."""
    w = F.pow(F.greatest(F.lit(0.0), F.col("sim")), 3)
    total = neighbours.groupBy("id").agg(F.sum(w).alias("total"), F.max("sim").alias("best"))
    votes = neighbours.join(scores.select(F.col("id").alias("neighbour"), "topic", "score"), "neighbour").groupBy("id", "topic").agg(F.sum(w * F.col("score")).alias("v"))
    mean = votes.join(total, "id").select("id", "topic", F.coalesce(F.try_divide("v", "total"), F.lit(0.0)).alias("m"))
    p = page.select("id", "topic", F.col("score").alias("p"))
    both = mean.join(p, ["id", "topic"], "full").join(page.select("id").distinct().withColumn("_has", F.lit(True)), "id", "left").join(total.select("id", "best"), "id", "left")
    m, own = F.coalesce("m", F.lit(0.0)), F.col("p")
    return both.select("id", "topic", F.when(own.isNotNull(), 0.6 * m + 0.4 * own).otherwise(m).alias("score"), "best")


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(id, vector) of rows by a model that maps a list of texts to a matrix; called in the tasks, `batch` texts at once."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "vector": list(unit(np.asarray(model(part[text].fillna("").tolist()), np.float64)))})

    return rows.select("id", text).mapInPandas(run, f"id {dict(rows.dtypes)['id']}, vector array<double>")
