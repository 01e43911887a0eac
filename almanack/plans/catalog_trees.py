"""Queries of neighbours, trees over vectors, places and names, each with SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from almanack.operators import cluster as T, search as X, vectors as V
from almanack.plans.catalog import Tables, query

_KNN = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 10 <> 3),
p AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id)
SELECT id, neighbour, round(sim, 6) AS sim, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, neighbour)::INT AS rank FROM p QUALIFY rank <= 5"""


@query(f"WITH {_KNN}")
def incremental_knn(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    before, now = e.where("id % 10 <> 7"), e.where("id % 10 <> 3")  # one tenth left, another came
    cached = V.knn(before, before, 5).select("id", "neighbour", "sim")
    return V.update_neighbours(cached, now, 5).select("id", "neighbour", F.round("sim", 6).alias("sim"), "rank")


@query("""WITH e AS (SELECT vec_id AS id, label % 3 AS ds, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.ds, b.id AS title, list_dot_product(a.v, b.v) AS sim, a.id FROM e a JOIN e b ON a.id <> b.id),
k AS (SELECT ds, title FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, title) <= 8), f AS (SELECT ds, title, count(*) AS n FROM k WHERE title % 4 <> 0 OR title % 3 <> ds GROUP BY ALL),
c AS (SELECT *, 'kind ' || title % 17 AS type FROM f QUALIFY row_number() OVER (PARTITION BY ds ORDER BY n DESC, title) <= 60), t AS (SELECT type, count(*) AS n, list_sort(list_distinct(list(title)))[1:6] AS examples FROM c WHERE type NOT IN ('kind 3', 'kind 5') GROUP BY type HAVING count(*) >= 3)
SELECT type, n, array_to_string(examples, ',') AS examples FROM t ORDER BY n DESC, type LIMIT 40""")
def type_radar(t):
    """Kinds met around the vectors of three data sets, of what those don't hold."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = V.knn(e, e, 8).join(t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("dataset")), "id").select("dataset", F.col("id").alias("seed"), F.col("neighbour").alias("title"))
    known = t.embeddings.where("vec_id % 4 = 0").select((F.col("vec_id") % 3).cast("int").alias("dataset"), F.col("vec_id").alias("title"))
    types = t.embeddings.select(F.col("vec_id").alias("title"), F.concat(F.lit("Kind "), (F.col("vec_id") % 17).cast("string")).alias("type"))
    return X.type_radar(near, known, types, ["kind 3", "kind 5"]).select("type", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def _spread(t: Tables):
    """Vectors of six well-parted groups: an axis for part % 3, another for part % 2, and a little of their own."""
    k = F.col("p_partkey")
    axis = lambda n, size: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == n, 1.0).otherwise(0.0))
    v = F.concat(axis(k % 3, 3), F.transform(axis(k % 2, 2), lambda x: 0.5 * x), F.array((k % 97) / 97 * 0.02, (k % 89) / 89 * 0.02))
    return t.part.where("p_partkey < 600").select(k.alias("id"), V.normalise(v).alias("vector"), (k % 3).alias("a"), (k % 2).alias("b"))


@query("""SELECT count(DISTINCT p_partkey % 6)::INT AS k FROM part WHERE p_partkey < 600""")
def chosen_groups(t):
    rows = _spread(t)
    return t.spark.createDataFrame([(T.choose_k(rows, 7, 5, probe=3),)], "k int")


@query("""SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_partkey % 6) AS first_of_group FROM part WHERE p_partkey < 600""")
def kmeans_groups(t):
    from pyspark.sql import Window

    found = V.spherical_kmeans(_spread(t), 6)
    return found.select("id", F.min("id").over(Window.partitionBy("cluster")).alias("first_of_group"))


@query("""SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_partkey % 6) AS first_of_group FROM part WHERE p_partkey < 600""")
def tree_leaves(t):
    from pyspark.sql import Window

    rows = _spread(t)
    tree = T.cluster_tree(rows.select("id", "vector"), leaf=25, branch=6, depth=1)
    return tree.select("id", F.min("id").over(Window.partitionBy("path")).alias("first_of_group"))


@query("""WITH s AS (SELECT vec_id AS id, label, label % 3 AS a FROM embeddings), n AS (SELECT label, count(*) AS n FROM s GROUP BY label)
SELECT id, min(id) OVER (PARTITION BY a) AS top, min(id) OVER (PARTITION BY label) AS mid, true AS leaf_ok, n > 32 AS deeper FROM s JOIN n USING (label)""")
def level_tree(t):
    """All embeddings, each moved towards its label % 3 and, less, towards its label, so that the first two levels of the tree are known."""
    from pyspark.sql import Window

    axis = lambda n, size, w: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == n, w).otherwise(0.0))
    v = F.concat(axis(F.col("label") % 3, 3, 4.0), axis(F.col("label"), 10, 1.0), F.transform("embedding", lambda x: 0.3 * x.cast("double")))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), V.normalise(v).alias("vector"))
    tree = T.cluster_tree(rows, leaf=20, branch=6, depth=4, local_rows=40)
    parts = F.split("path", "/")
    level = lambda n: F.min("id").over(Window.partitionBy(F.slice(parts, 1, n + 1)))
    size = F.count("*").over(Window.partitionBy("path"))
    return tree.select("id", level(1).alias("top"), level(2).alias("mid"), ((size <= 32) | (F.size(parts) == 5)).alias("leaf_ok"), (F.size(parts) > 3).alias("deeper"))


@query("""SELECT p_partkey AS id, p_partkey % 3 AS top, min(p_partkey) OVER (PARTITION BY p_partkey % 6) AS first_of_group FROM part WHERE p_partkey < 600""")
def taxonomy_tree(t):
    from pyspark.sql import Window

    rows = _spread(t)
    tree = T.cluster_tree(rows, leaf=25, branch=3, depth=2, known=F.concat(F.lit("r/"), F.col("a").cast("string")))
    return tree.select("id", F.split("path", "/")[1].cast("long").alias("top"), F.min("id").over(Window.partitionBy("path")).alias("first_of_group"))


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey < 600 ORDER BY p_partkey LIMIT 100""")
def reclustered_subset(t):
    rows = _spread(t)
    return T.recluster(rows.select("id", "vector"), rows.where("id % 2 = 0").select("id"), most=100, leaf=10, branch=4, depth=2).select("id")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e), m AS (SELECT label, d, avg(x) AS x FROM u GROUP BY label, d),
c AS (SELECT label, list(x ORDER BY d) AS c FROM m GROUP BY label), n AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c),
f AS (SELECT vec_id, e.label, min(1 - list_dot_product(v, c)) FILTER (n.label = e.label) AS own, min(1 - list_dot_product(v, c)) FILTER (n.label <> e.label) AS other FROM e, n GROUP BY vec_id, e.label)
SELECT label, round(avg((other - own) / greatest(own, other)), 6) AS silhouette FROM f GROUP BY label""")
def silhouettes(t):
    """The mean silhouette of each label's embeddings, by distances to centres."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    return T.group_silhouettes(rows).select(F.col("group").alias("label"), F.round("silhouette", 6).alias("silhouette"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size % 4 AS g, (p_partkey % 50)::DOUBLE AS x FROM part) SELECT id, g, round(x - avg(x) OVER (PARTITION BY g), 6) AS projection FROM s""")
def principal_axes(t):
    x = (F.col("p_partkey") % 50).cast("double")
    rows = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("g"), F.array(0.6 * x + 1, 0.8 * x - 2, F.lit(3.0)).alias("vector"))
    return T.principal_axis(rows, "g").select("id", "g", F.round("projection", 6).alias("projection"))


@query("""SELECT c_custkey // 5 AS parent, row_number() OVER (PARTITION BY c_custkey // 5 ORDER BY c_custkey * 3 % 5)::INT - 1 AS place, c_custkey AS node FROM customer""")
def sibling_order(t):
    """Five siblings a parent on a quarter of a circle, mixed up; the shortest way from its beginning takes them as they lie."""
    k = F.col("c_custkey")
    angle = (k * 3 % 5) * 0.3 + 0.1
    nodes = t.customer.select(F.floor(k / 5).alias("parent"), k.alias("node"), F.array(F.cos(angle), F.sin(angle)).alias("vector"))
    return T.order_siblings(nodes, left=[1.0, 0.0])


_BANDS = """l AS (SELECT p_type AS leaf, count(*) AS n FROM part GROUP BY p_type), w AS (SELECT *, row_number() OVER (ORDER BY leaf) AS seq, pow(n, 0.75) + 0.6 AS w FROM l),
b AS (SELECT leaf, seq, n, (sum(w) OVER (ORDER BY seq) - w) / sum(w) OVER () AS y0, sum(w) OVER (ORDER BY seq) / sum(w) OVER () AS y1, 0.3 / sum(w) OVER () AS pad FROM w)"""


def _bands(t):
    from pyspark.sql import Window

    leaves = t.part.groupBy(F.col("p_type").alias("leaf")).agg(F.count("*").alias("n")).withColumn("seq", F.row_number().over(Window.orderBy("leaf")))
    return T.leaf_bands(leaves)


@query(f"WITH {_BANDS} SELECT leaf, round(y0, 6) AS y0, round(y1, 6) AS y1, round(y0 + pad, 6) AS inner0 FROM b")
def leaf_bands(t):
    return _bands(t).select("leaf", *[F.round(c, 6).alias(c) for c in ("y0", "y1", "inner0")])


_ENDS = """f AS (SELECT leaf, seq, CASE WHEN seq % 3 = 0 THEN [0.0, 1.0] ELSE [1.0, 0.0] END AS a, CASE WHEN seq % 3 = 0 THEN [1.0, 0.0] ELSE [0.0, 1.0] END AS z FROM b),
fl AS (SELECT leaf, seq, a, z, false AS flip FROM f WHERE seq = 1 UNION ALL SELECT f.leaf, f.seq, f.a, f.z, list_dot_product(CASE WHEN fl.flip THEN fl.a ELSE fl.z END, f.z) > list_dot_product(CASE WHEN fl.flip THEN fl.a ELSE fl.z END, f.a) FROM fl JOIN f ON f.seq = fl.seq + 1)"""


def _flips(t):
    ends = _bands(t).select("leaf", "seq", F.when(F.col("seq") % 3 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("first"), F.when(F.col("seq") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("last"))
    return T.leaf_flips(ends)


@query(f"WITH RECURSIVE {_BANDS}, {_ENDS} SELECT leaf, flip FROM fl")
def leaf_flips(t):
    return _flips(t)


@query(f"""WITH RECURSIVE {_BANDS}, {_ENDS}, r AS (SELECT p_partkey AS id, p_type AS leaf, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN flip THEN -p_size ELSE p_size END, CASE WHEN flip THEN -p_partkey ELSE p_partkey END) - 1 AS rank, count(*) OVER (PARTITION BY p_type) AS n FROM part JOIN fl ON leaf = p_type)
SELECT id, leaf, rank::INT AS rank, round(y0 + pad + CASE WHEN r.n = 1 THEN 0.5 ELSE (rank + 0.5) / r.n END * (y1 - y0 - 2 * pad), 6) AS y FROM r JOIN b USING (leaf)""")
def rows_in_bands(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("leaf"), F.col("p_size").alias("projection"))
    return T.rows_in_bands(rows, _bands(t), _flips(t)).select("id", "leaf", "rank", F.round("y", 6).alias("y"))


@query("""SELECT p_partkey AS id, (CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 2 THEN 1 ELSE p_partkey % 3 + 1 END * 10 + p_partkey % 2) AS node FROM part WHERE p_partkey < 600 AND NOT (p_partkey % 5 = 0 AND p_partkey % 3 = 2) UNION ALL SELECT p_partkey, 30 + p_partkey % 2 FROM part WHERE p_partkey < 600 AND p_partkey % 5 = 0 AND p_partkey % 3 = 2""")
def frozen_tree_placement(t):
    rows = _spread(t)
    axis = lambda n, size: [1.0 if i == n else 0.0 for i in range(size)]
    nodes = [(0, None, [0.0] * 7)] + [(a + 1, 0, axis(a, 3) + [0.0] * 4) for a in range(3)] + [((a + 1) * 10 + b, a + 1, axis(a, 3) + [0.5 * x for x in axis(b, 2)] + [0.0, 0.0]) for a in range(3) for b in range(2)]
    start = F.when((F.col("id") % 5 == 0) & (F.col("id") % 3 != 2), 1).when(F.col("id") % 5 == 0, 99)
    tree = t.spark.createDataFrame(nodes, "node int, parent int, centroid array<double>")
    return T.place_in_tree(rows, tree, start, 2).select("id", F.col("node").cast("long").alias("node"))


@query("""WITH r AS (SELECT p_partkey AS id, p_type AS leaf, p_size AS s, CASE WHEN p_partkey % 4 = 0 THEN 0.1 + p_size / 100.0 END AS y FROM part),
g AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY leaf ORDER BY s, id), 0.05) AS lo, coalesce(first_value(y IGNORE NULLS) OVER (PARTITION BY leaf ORDER BY s, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.95) AS hi, count(y) OVER (PARTITION BY leaf ORDER BY s, id) AS run FROM r)
SELECT id, round(CASE WHEN y IS NOT NULL THEN y ELSE lo + (hi - lo) * row_number() OVER (PARTITION BY leaf, run, y IS NULL ORDER BY s, id) / (count(*) OVER (PARTITION BY leaf, run, y IS NULL) + 1) END, 6)::DOUBLE AS y FROM g""")
def gap_places(t):
    y = F.when(F.col("p_partkey") % 4 == 0, 0.1 + F.col("p_size") / 100)
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("leaf"), F.col("p_size").alias("projection"), y.alias("y"), F.lit(0.05).alias("inner0"), F.lit(0.95).alias("inner1"))
    return T.fill_gaps(rows).select("id", F.round("y", 6).alias("y"))


_BAGS = """g AS (SELECT p_type AS node, term, sum(w) AS w FROM (SELECT p_type, p_name AS term, 3 AS w FROM part UNION ALL SELECT p_type, unnest(string_split(p_name, ' ')), 1 FROM part) GROUP BY ALL),
s AS (SELECT node, term, w / sum(w) OVER (PARTITION BY node) * ln(1 + sum(w) OVER () / sum(w) OVER (PARTITION BY term)) AS score FROM g),
r AS (SELECT node, term, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, term) AS r FROM s QUALIFY r <= 24),
k AS (SELECT node, list_reduce(list(term ORDER BY r), lambda acc, x: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda y: contains(y, x) OR contains(x, y))) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS terms FROM r GROUP BY node)"""


@query("""WITH g AS (SELECT p_type AS node, term, sum(w) AS w FROM (SELECT p_type, p_name AS term, 3 AS w FROM part UNION ALL SELECT p_type, unnest(string_split(p_name, ' ')), 1 FROM part) GROUP BY ALL),
s AS (SELECT node, term, w / sum(w) OVER (PARTITION BY node) * ln(1 + sum(w) OVER () / sum(w) OVER (PARTITION BY term)) AS score FROM g)
SELECT node, arg_max(term, (round(score, 9), -ascii(term), -length(term))) AS best, true AS no_parts FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, term) AS r FROM s) WHERE r = 1 GROUP BY node""")
def node_terms(t):
    whole = t.part.select(F.col("p_type").alias("node"), F.col("p_name").alias("term"), F.lit(3).alias("weight"))
    words = t.part.select(F.col("p_type").alias("node"), F.explode(F.split("p_name", " ")).alias("term"), F.lit(1).alias("weight"))
    found = T.node_terms(whole.unionByName(words))
    parts = F.exists("terms", lambda a: F.exists("terms", lambda b: (a != b) & F.contains(a, b)))
    return found.select("node", F.get("terms", F.lit(0)).alias("best"), (~parts).alias("no_parts"))


@query("""WITH e AS (SELECT vec_id AS id, label AS node, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT node, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e), m AS (SELECT node, d, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT node, list(m ORDER BY d) AS c FROM m GROUP BY node)
SELECT e.node, arg_max(id, (round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9), -id)) AS id FROM e JOIN c USING (node) GROUP BY e.node""")
def exemplars(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("node"), F.col("embedding").alias("vector"))
    c = V.centroids(rows, "node", "vector")
    lists = c.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centroid"))
    return T.exemplars(rows, lists)


@query("""SELECT c_custkey * 10 + d AS node, lead FROM customer, (VALUES (1, 'war'), (2, 'art'), (3, 'war')) v(d, lead)""")
def sibling_leads(t):
    """Of two siblings that want a term the better fit has it; nodes of another parent may use it again."""
    k = F.col("c_custkey")
    of = lambda rows, names: F.explode(F.array(*[F.struct(*[F.array(*map(F.lit, v)).alias(n) if isinstance(v, list) else F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))
    nodes = t.customer.select(k, of([(1, 0, 10, [1.0, 0.0]), (2, 0, 10, [0.9, 0.4]), (3, 1, 10, [1.0, 0.0])], ("d", "p", "n", "centroid")).alias("x")).select((k * 10 + F.col("x.d")).alias("node"), (k * 2 + F.col("x.p")).alias("parent"), "x.n", "x.centroid")
    inside = t.customer.select(k, of([(1, "war", 9), (1, "art", 1), (2, "war", 8), (2, "art", 7), (3, "war", 5)], ("d", "term", "n")).alias("x")).select((k * 10 + F.col("x.d")).alias("node"), "x.term", "x.n")
    terms = t.region.limit(1).select(of([("war", 10, [1.0, 0.0]), ("art", 10, [0.0, 1.0])], ("term", "df", "vector")).alias("x")).select("x.*")
    return T.semantic_terms(nodes, terms, inside, 100)


@query("""SELECT c_custkey * 10 + d AS node, label FROM customer, (VALUES (1, 'Art · Cubism'), (2, 'Art · Fresco'), (3, 'War')) v(d, label)""")
def distinct_labels(t):
    k = F.col("c_custkey")
    three = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(label).alias("label"), F.array(*map(F.lit, terms)).alias("terms")) for d, label, terms in ((1, "Art", ["art", "cubism"]), (2, "Art", ["war", "fresco"]), (3, "War", ["war"]))])
    nodes = t.customer.select(k, F.explode(three).alias("x")).select((k * 10 + F.col("x.d")).alias("node"), k.alias("parent"), "x.label", "x.terms")
    return T.distinct_labels(nodes).select("node", "label")


_SCORES = """CASE c_custkey % 5 WHEN 0 THEN map('Culture.Biography.Biography*', {b}, 'Culture.Literature', {l}) WHEN 1 THEN map('STEM.STEM*', 0.9D, 'STEM.Physics', 0.2D) WHEN 2 THEN map('Culture.Biography.Biography*', 0.9D, 'Culture.Literature', 0.1D)
WHEN 3 THEN map('Geography.Regions.Europe.Europe*', 0.9D, 'Geography.Regions.Europe.Northern_Europe', 0.5D, 'History_and_Society.History', 0.3D) ELSE map('Geography.Regions.Asia.Asia*', 0.3D) END"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Culture.Literature' WHEN 1 THEN 'STEM.Physics' WHEN 2 THEN 'Culture.Biography.Biography*' WHEN 3 THEN 'History_and_Society.History' END AS topic, CASE c_custkey % 5 WHEN 0 THEN 0.4 WHEN 1 THEN 0.2 WHEN 2 THEN 0.9 WHEN 3 THEN 0.3 END::DOUBLE AS score, CASE WHEN c_custkey % 5 = 3 THEN 'Europe › Northern_Europe' END AS region FROM customer""")
def primary_labels(t):
    rows = t.customer.selectExpr("c_custkey AS id", _SCORES.format(b="0.8D", l="0.4D") + " AS s")
    return rows.select("id", T.primary_label(F.col("s")).alias("p"), T.region_label(F.col("s")).alias("region")).select("id", "p.topic", "p.score", "region")


@query("""SELECT doc_id AS id, CASE lang WHEN 'en' THEN 0.95 WHEN 'de' THEN 0.9 END::DOUBLE AS prior FROM documents""")
def dataset_priors(t):
    s = T.prior_scores(F.col("lang"), {"en": {"Culture.Media.Films": 0.95, "Culture.Media.Media*": 0.9}, "de": {"Culture.Media.Films": 0.9}})
    return t.documents.select(F.col("doc_id").alias("id"), F.element_at(s, F.lit("Culture.Media.Films")).alias("prior"))


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.id, b.id AS n, b.label, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, n) <= 15), w AS (SELECT id, sum(greatest(0, sim) ** 3) AS total FROM k GROUP BY id),
m AS (SELECT k.id, label AS topic, sum(greatest(0, sim) ** 3 * 0.8) / any_value(total) AS m FROM k JOIN w ON w.id = k.id GROUP BY ALL), g AS (SELECT vec_id AS id, 99 AS topic, 0.5 AS p FROM embeddings WHERE vec_id % 3 = 0)
SELECT id, topic, round(CASE WHEN p IS NOT NULL THEN 0.6 * coalesce(m, 0) + 0.4 * p ELSE m END, 6)::DOUBLE AS score FROM m FULL JOIN g USING (id, topic)""")
def voted_scores(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))
    page = e.where("id % 3 = 0").select("id", F.lit(99).alias("topic"), F.lit(0.5).alias("score"))
    found = T.voted_scores(V.knn(e, e, 15), e.select("id", "topic", F.lit(0.8).alias("score")), page)
    return found.select("id", "topic", F.round("score", 6).alias("score"))


def _letters(texts: list[str]) -> np.ndarray:
    """A stand-in for a model: counts of three letters, and one."""
    return np.array([[s.count("a"), s.count("e"), s.count("o"), 1] for s in texts], float)


@query("""WITH c AS (SELECT p_partkey AS id, length(p_name) - length(replace(p_name, 'a', '')) AS a, length(p_name) - length(replace(p_name, 'e', '')) AS e, length(p_name) - length(replace(p_name, 'o', '')) AS o FROM part) SELECT id, round(a / sqrt(a * a + e * e + o * o + 1), 6) AS first_value FROM c""")
def embedded_texts(t):
    v = T.embed(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "text", _letters)
    return v.select("id", F.round(F.get("vector", F.lit(0)), 6).alias("first_value"))


@query("""WITH q AS (SELECT [CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE FOR i IN range(64)] AS q), s AS (SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / 8 AS sim FROM embeddings, q) SELECT id, round(sim, 6) AS sim FROM s ORDER BY round(sim, 9) DESC, id LIMIT 10""")
def nearest_to_query(t):
    hits = X.semantic_scan(t.embeddings, "vec_id", "embedding", [1.0 if i % 2 == 0 else -1.0 for i in range(64)])
    return hits.orderBy(F.desc(F.round("sim", 9)), "id").limit(10).select("id", F.round("sim", 6).alias("sim"))
