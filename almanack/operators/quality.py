"""Rules over a store and its layouts, counted in passes over whole tables, and findings about topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.functions import text as X
from almanack.operators.search import cosine


def broken(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(rule, violations): rows of a table that break each rule; rules of one table share a pass."""
    tables: dict[int, tuple[DataFrame, list]] = {}
    for name, (table, test) in rules.items():
        tables.setdefault(id(table), (table, []))[1].append(F.count_if(F.coalesce(test, F.lit(False))).alias(name))
    out = None
    for table, counts in tables.values():
        part = table.agg(*counts)
        part = part.unpivot([], part.columns, "rule", "violations")
        out = part if out is None else out.unionByName(part)
    return out


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once; nulls aside."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    return rows.join(other.select(F.col(other_key or key).alias(key)), key, "left_anti")


def entry_rules(entries: DataFrame, now: int) -> dict[str, tuple[DataFrame, Column]]:
    """Rules that one entry (id, start, end, kind, text_start, text_end, wiki, qid, manual, dataset, known_dataset) can break."""
    end = F.col("end")
    return {
        "has a start": (entries, F.col("start").isNull()),
        "runs forwards": (entries, end < F.col("start")),
        "is not after the present": (entries, F.greatest("start", "end") > now),
        "text gives the start": (entries, F.col("text_start") != F.col("start")),
        "text gives the end of a span": (entries, (F.col("kind") == "span") & (F.col("text_end") != end)),
        "has an origin": (entries, F.col("wiki").isNull() & F.col("qid").isNull() & ~F.col("manual") & ~F.col("known_dataset")),
        "kind is point or span": (entries, ~F.col("kind").isin("point", "span")),
        "point has one year": (entries, (F.col("kind") == "point") & (end != F.col("start"))),
        "id has three parts": (entries, ~F.col("id").cast("string").rlike(r"^[^:]+:[^:]+:[^:]+\z")),
    }


def point_rules(points: DataFrame, bands: DataFrame) -> dict[str, tuple[DataFrame, Column]]:
    """Rules of placed points (id, leaf, x0, x1, y, fame, neighbours) and of the tree's nodes' bands (node, parent, is_leaf, y0, y1, x0, x1, n)."""
    held = points.join(bands.select(F.col("node").alias("leaf"), "is_leaf", "y0", "y1", F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), "leaf", "left")
    up = bands.alias("c").join(bands.alias("p"), F.col("c.parent") == F.col("p.node"))
    inside = up.select(F.col("c.node").alias("node"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "cp" for c in ("y0", "y1", "x0", "x1")])
    order = Window.partitionBy("parent").orderBy("y0", "node")
    siblings = bands.where("parent IS NOT NULL").withColumn("before", F.lag("y1").over(order))
    leaves = bands.where("is_leaf").withColumn("before", F.lag("y1").over(Window.orderBy("y0")))
    slack = 1e-4
    return {
        "y in range": (held, ~F.col("y").between(0, 1)),
        "fame in range": (held, ~F.col("fame").between(0, 1)),
        "point is on a leaf": (held, ~F.coalesce("is_leaf", F.lit(False))),
        "point is in its band": (held, (F.col("y") < F.col("y0") - slack) | (F.col("y") > F.col("y1") + slack)),
        "point is in its node's years": (held, (F.col("x0") < F.col("bx0")) | (F.col("x1") > F.col("bx1"))),
        "no self among neighbours": (held, F.array_contains("neighbours", F.col("id"))),
        "no neighbour twice": (held, F.size("neighbours") != F.size(F.array_distinct("neighbours"))),
        "bands lie in their parents": (inside, (F.col("c_y0") < F.col("p_y0") - slack) | (F.col("c_y1") > F.col("p_y1") + slack)),
        "years lie in their parents": (inside, (F.col("c_x0") < F.col("p_x0")) | (F.col("c_x1") > F.col("p_x1"))),
        "siblings do not overlap": (siblings, F.col("y0") < F.col("before") - slack),
        "leaves leave no gap": (leaves, F.abs(F.col("y0") - F.coalesce("before", F.lit(0.0))) > slack),
    }


def member_counts(points: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (node, n) whose count isn't that of the points below them; closure is (leaf, node) of every node above a leaf, itself included."""
    counted = points.groupBy("leaf").agg(F.count("*").alias("c")).join(closure, "leaf").groupBy("node").agg(F.sum("c").alias("c"))
    return nodes.join(counted, "node", "left").where(F.coalesce("c", F.lit(0)) != F.col("n")).select("node", "n", "c")


def unit_length(vectors: DataFrame, slack: float = 0.02) -> tuple[DataFrame, Column]:
    v = F.col("vector")
    return vectors, F.abs(F.sqrt(cosine(v, v)) - 1) > slack


def order_means_likeness(rows: DataFrame) -> DataFrame:
    """(adjacent, apart) of rows (id, y, vector): the mean cosine of neighbours in y, and of rows with one that a hash of its id pairs it with."""
    numbered = rows.withColumn("before", F.lag("vector").over(Window.partitionBy("group").orderBy("y", "id")))
    adjacent = numbered.where("before IS NOT NULL").agg(F.avg(cosine(F.col("vector"), F.col("before"))).alias("adjacent"))
    mixed = rows.withColumn("before", F.lag("vector").over(Window.partitionBy("group").orderBy(F.xxhash64("id"), "id")))
    apart = mixed.where("before IS NOT NULL").agg(F.avg(cosine(F.col("vector"), F.col("before"))).alias("apart"))
    return adjacent.join(apart)  # one row each


def moved_by_placement(placed: DataFrame, stored: DataFrame, most: float = 0.12) -> DataFrame:
    """(share, ok): how many rows a frozen tree would put elsewhere than they are stored."""
    both = placed.join(stored.select("id", F.col("node").alias("_was")), "id")
    return both.agg(F.avg((F.col("node") != F.col("_was")).cast("int")).alias("share")).withColumn("ok", F.col("share") < most)


# topics ------------------------------------------------------------------------------------------------------


def topic_findings(topics: DataFrame, chapters: DataFrame, items: DataFrame) -> DataFrame:
    """(topic, kind, about): what is weak in topics (topic, intro, chronological), their chapters (topic, chapter, title, intro, from, to, points) and
    items (topic, id, title, type, chapter, is_key, key_idea, context, note, in_intro, via, on_timeline, start)."""
    ch = chapters.select("topic", "chapter", F.col("title").alias("chapter_title"), F.coalesce("intro", F.lit("")).alias("intro"), "from", "to", "points")
    key = items.where("is_key").join(ch, ["topic", "chapter"], "left").join(topics.select("topic", "chronological"), "topic")
    context, intro = F.coalesce("context", F.lit("")), F.coalesce("intro", F.lit(""))
    length = F.greatest(F.lit(30), F.col("to") - F.col("from"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = {
        "generic": X.is_general_title(F.col("title"), F.col("type")),
        "no-context": blank("context") & blank("note") & ~F.col("in_intro") & ~F.col("via").isin("works", "events"),
        "dup-intro": (context != "") & (intro != "") & (F.contains(intro, F.left(context, F.lit(90))) | F.contains(context, F.left(intro, F.lit(90)))),
        "far-date": F.col("chronological") & (F.col("type") != "person") & ((F.col("start") < F.col("from") - length) | (F.col("start") > F.col("to") + length)),
    }
    kinds = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    of_items = key.select("topic", F.explode(kinds).alias("kind"), F.col("title").alias("about"))
    texts = topics.select("topic", F.lit("topic intro").alias("about"), "intro").unionByName(chapters.select("topic", F.col("title").alias("about"), "intro"))
    two = F.filter(F.array(F.when(X.is_boilerplate(F.col("intro")), "boilerplate"), F.when(X.has_apparatus(F.left("intro", F.lit(300))), "apparatus")), lambda x: x.isNotNull())
    of_texts = texts.where("intro IS NOT NULL").select("topic", F.explode(two).alias("kind"), "about")
    n = items.groupBy("topic", "chapter").agg(F.count_if("is_key").alias("keys"), F.count_if("on_timeline").alias("shown"), F.count_if(F.col("is_key") | F.col("key_idea")).alias("told"))
    c = ch.join(n, ["topic", "chapter"], "left")
    thin = c.where((F.coalesce("keys", F.lit(0)) < 2) & (F.col("shown") > 0)).select("topic", F.lit("thin-chapter").alias("kind"), F.col("chapter_title").alias("about"))
    bare = c.where((F.coalesce(F.size("points"), F.lit(0)) <= 0) & ((F.col("intro") != "") | (F.col("told") > 0)))
    no_points = bare.groupBy("topic").agg(F.count("*").cast("string").alias("about")).select("topic", F.lit("no-points").alias("kind"), "about")
    shown = topics.select("topic").join(items.where("on_timeline").groupBy("topic").agg(F.count("*").alias("n")), "topic", "left").where(F.coalesce("n", F.lit(0)) < 60)
    small = shown.select("topic", F.lit("thin-topic").alias("kind"), F.coalesce("n", F.lit(0)).cast("string").alias("about"))
    return of_items.unionByName(of_texts).unionByName(thin).unionByName(small).unionByName(no_points)
