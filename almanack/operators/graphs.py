"""Graphs as edge tables: components, co-mentions, related entries, series, tree checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node reachable.

    Each round a node takes the least label among its own, its neighbours' and its label's label; rounds grow with
    the logarithm of a component's diameter, and each is cut off in the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        up = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        new = near.unionByName(up).groupBy("node").agg(F.min("label").alias("new"))
        step = cut(labels.join(new, "node").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels


def _pairs(things: Column) -> Column:
    """array of struct(a, b), a < b, of a sorted array of distinct things."""
    return F.flatten(F.transform(things, lambda x, i: F.transform(F.slice(things, i + 2, F.size(things)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def co_mentions(links: DataFrame, most: int = 12) -> DataFrame:
    """(a, b, weight), a < b, from links (paragraph, sentence, target): 1 for each paragraph of at most `most` targets
    that names both, and 3 for each pair of mentions in one sentence.

    Paragraphs beyond `most` make no pairs. Mentions of a sentence are counted before they meet, so a sentence
    makes one row for each pair of its targets.
    """
    per = links.groupBy("paragraph").agg(F.sort_array(F.collect_set("target")).alias("ts")).where(F.size("ts") <= most)
    near = per.select(F.explode(_pairs(F.col("ts"))).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("w"))
    said = links.groupBy("paragraph", "sentence", "target").agg(F.count("*").alias("n"))
    x, y = said.select("paragraph", "sentence", F.col("target").alias("a"), F.col("n").alias("na")), said.select("paragraph", "sentence", F.col("target").alias("b"), F.col("n").alias("nb"))
    same = x.join(y, ["paragraph", "sentence"]).where("a < b").select("a", "b", (3 * F.col("na") * F.col("nb")).alias("w"))
    return near.unionByName(same).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def related(pairs: DataFrame, relatable: DataFrame, most: int = 6) -> DataFrame:
    """(id, place, other): the `most` strongest co-mentions (a, b, weight) of each entry among relatable ones (id)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").union(pairs.select("b", "a", "weight"))
    kept = both.join(relatable.select(F.col("id").alias("other")), "other", "left_semi")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "other"))
    return kept.withColumn("place", order).where(F.col("place") <= most).select("id", "place", "other")


def series_order() -> list[Column]:
    """Series as they are offered: those of a main role first, then the larger and the better known on the topic."""
    return [F.col("role") != "main", F.desc(F.col("size") * F.log1p("on")), F.col("name")]


def tree_cycles(nodes: DataFrame, depth: int = 50) -> DataFrame:
    """(id) of nodes (id, parent) that no root leads to: they are in a cycle, under one, or under a missing parent."""
    from almanack.operators.resolve import tree_paths

    return nodes.select("id").join(tree_paths(nodes, depth).select("id"), "id", "left_anti")


def display_order(paths: DataFrame, place: DataFrame) -> DataFrame:
    """paths (id, path) with n, depth-first in the order of place (id, at): parents before children."""
    steps = paths.select("id", F.posexplode("path").alias("i", "step")).join(place.select(F.col("id").alias("step"), "at"), "step")
    keys = steps.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "at", "step"))), lambda x: F.struct(x["at"], x["step"])).alias("k"))
    from almanack.operators.ranking import numbered

    return numbered(keys, F.asc("k")).select("id", (F.col("n") + 1).alias("n"))
