"""Queries that run the operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from almanack.functions import dates as D, strings as S
from almanack.functions.text import per_text
from almanack.operators import ranking as K, resolve as R, search as X, temporal as T, vectors as V
from almanack.session import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def entries(self) -> DataFrame:
        """Orders as dated entries: a point or a span of years, a person or not, open-ended or not."""
        year = F.year("o_orderdate").cast("long")
        span = F.col("o_orderkey") % 3 == 0
        return self.orders.select(
            F.col("o_orderkey").alias("id"), year.alias("start"),
            F.when(span, year + F.col("o_orderkey") % 5).alias("end"),
            F.when(span, "span").otherwise("point").alias("kind"),
            (F.col("o_orderkey") % 4 == 0).alias("person"), (span & (F.col("o_orderkey") % 9 == 0)).alias("open_ended"),
            F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("fame"),
        )


ENTRIES = """entries AS (SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS start,
  CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::BIGINT + o_orderkey % 5 END AS "end",
  CASE WHEN o_orderkey % 3 = 0 THEN 'span' ELSE 'point' END AS kind,
  o_orderkey % 4 = 0 AS person, (o_orderkey % 3 = 0 AND o_orderkey % 9 = 0) AS open_ended,
  o_custkey AS grp, o_orderpriority AS topic, o_orderstatus AS status, o_totalprice AS fame FROM orders)"""
TOKENS = """words AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents)"""


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def plain_tokens(c):
    """Tokens that DuckDB can split alike, for the queries with an oracle."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


# retrieval -----------------------------------------------------------------------------------

_BM25 = f"""WITH {TOKENS}, t AS (SELECT * FROM words WHERE w <> ''), dl AS (SELECT id, count(*) AS dl FROM t GROUP BY id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents)::DOUBLE AS a),
h AS (SELECT id, w, count(*) AS tf FROM t WHERE w IN ('the', 'onhe', 'tion') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM h GROUP BY w),
bm AS (SELECT h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score, count(*) AS have
FROM h JOIN df USING (w) JOIN dl USING (id), s GROUP BY h.id HAVING count(*) >= 2)"""


def _keyword(t: Tables) -> DataFrame:
    return X.bm25(t.documents, "doc_id", plain_tokens(F.col("text")), ["the", "onhe", "tion"])


@query(_BM25 + " SELECT id, round(score, 6) AS score FROM bm")
def bm25_search(t):
    return _keyword(t).select("id", F.round("score", 6).alias("score"))


@query(_BM25 + " SELECT id, round(score, 6) AS score FROM bm WHERE score >= 0.3 * (SELECT max(score) FROM bm)")
def keyword_pruning(t):
    return X.prune_to_best(_keyword(t)).select("id", F.round("score", 6).alias("score"))


_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_SEM = """q AS (SELECT [CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END::DOUBLE FOR i IN range(64)] AS q), qn AS (SELECT list_transform(q, lambda x: x / sqrt(list_sum(list_transform(q, lambda y: y * y)))) AS q FROM q),
sem AS (SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) AS sim FROM embeddings, qn)"""


@query(f"WITH {_SEM} SELECT id, round(sim, 6) AS sim FROM sem")
def semantic_scan(t):
    return X.semantic_scan(t.embeddings, "vec_id", "embedding", _QUERY).select("id", F.round("sim", 6).alias("sim"))


@query(f"WITH {_SEM}, b AS (SELECT max(sim) AS m FROM sem) SELECT id, round(sim, 6) AS sim FROM sem, b WHERE m >= 0.1 AND sim >= greatest(0.05, m - 0.2) ORDER BY sim DESC, id LIMIT 200")
def semantic_cut(t):
    return X.cut_semantic(X.semantic_scan(t.embeddings, "vec_id", "embedding", _QUERY), 0.1, 0.2, 0.05, 200).select("id", F.round("sim", 6).alias("sim"))


@query(_BM25 + f", {_SEM} SELECT bm.id, round(score, 6) AS score FROM bm LEFT JOIN sem USING (id) WHERE coalesce(sim, 1) >= 0.02")
def semantic_veto(t):
    return X.veto(_keyword(t), X.semantic_scan(t.embeddings, "vec_id", "embedding", _QUERY), 0.02).select("id", F.round("score", 6).alias("score"))


@query(_BM25 + f""", {_SEM}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM bm QUALIFY r < 2000), b AS (SELECT id, row_number() OVER (ORDER BY round(sim, 9) DESC, id) - 1 AS r FROM sem QUALIFY r < 2000)
SELECT id, round(coalesce(0.9 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (id)""")
def rank_fusion(t):
    sem = X.semantic_scan(t.embeddings, "vec_id", "embedding", _QUERY).select("id", F.round("sim", 9).alias("sim"))
    return X.fuse(_keyword(t).select("id", F.round("score", 9).alias("score")), sem).select("id", F.round("score", 9).alias("score"))


_HYBRID = """bk AS (SELECT * FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, id LIMIT 2000) {scope}), kw AS (SELECT id, score FROM bk WHERE round(score, 9) >= 0.3 * (SELECT max(round(score, 9)) FROM bk) ORDER BY round(score, 9) DESC, id LIMIT 200),
ss AS (SELECT * FROM sem {scope}), kv AS (SELECT kw.id, row_number() OVER (ORDER BY round(score, 9) DESC, kw.id) - 1 AS r FROM kw LEFT JOIN ss USING (id) WHERE coalesce(sim, 1) >= 0.26),
sc AS (SELECT id, row_number() OVER (ORDER BY round(sim, 9) DESC, id) - 1 AS r FROM ss WHERE (SELECT max(sim) FROM ss) >= 0.4 AND sim >= greatest({least}, (SELECT max(sim) FROM ss) - {window}) QUALIFY r < {limit})
SELECT id, round(coalesce(0.9 / (60 + kv.r), 0) + coalesce(1.0 / (60 + sc.r), 0), 9) AS score FROM kv FULL JOIN sc USING (id) ORDER BY score DESC, id LIMIT 200"""
_NEAR = """q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 3), sem AS (SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt((SELECT list_sum(list_transform(q, lambda x: x * x)) FROM q)) AS sim FROM embeddings, q)"""


def _hybrid(t: Tables, scope: DataFrame | None, **how) -> DataFrame:
    query = [float(x) for x in t.embeddings.where("vec_id = 3").first().embedding]
    keyword = _keyword(t).select("id", F.round("score", 9).alias("score"))
    sem = X.semantic_scan(t.embeddings, "vec_id", "embedding", query).select("id", F.round("sim", 9).alias("sim"))
    return X.hybrid(keyword, sem, scope, **how).select("id", F.round("score", 9).alias("score"))


@query(_BM25 + f", {_NEAR}, " + _HYBRID.format(scope="", least=0.4, window=0.16, limit=200))
def hybrid_search(t):
    return _hybrid(t, None)


@query(_BM25 + f", {_NEAR}, " + _HYBRID.format(scope="WHERE id % 3 = 0", least=0.3, window=0.2, limit=12))
def scoped_search(t):
    """The scope applies to the best 2,000 keyword hits of all."""
    return _hybrid(t, t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


@query(_BM25 + f", {_NEAR}, " + _HYBRID.format(scope="", least=0.3, window=0.2, limit=12).replace("SELECT * FROM bm ORDER", "SELECT * FROM bm WHERE id % 3 = 0 ORDER").replace("ss AS (SELECT * FROM sem )", "ss AS (SELECT * FROM sem WHERE id % 3 = 0)"))
def scope_first_search(t):
    """Only the scope's rows are hits, however many better ones there are outside."""
    return _hybrid(t, t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")), scope_first=True)


_INDEX = f"""WITH {TOKENS}, t AS (SELECT id, w AS term, count(*) AS tf FROM words WHERE length(w) > 1 GROUP BY ALL),
x AS (SELECT id, term, round(tf / (tf + 1.2), 3) AS weight FROM t), d AS (SELECT term, count(*) AS df FROM x GROUP BY term)"""


def _weighted(t: Tables) -> DataFrame:
    tf = X.term_frequencies(t.documents, "doc_id", plain_tokens(F.col("text"))).where(F.length("term") > 1)
    return tf.select("id", "term", F.round(F.col("tf") / (F.col("tf") + 1.2), 3).alias("weight"))  # one row a text and term already


@query(_INDEX + """ SELECT substr(term, 1, 2) AS shard, term, df, id, weight FROM x JOIN d USING (term)
QUALIFY row_number() OVER (PARTITION BY term ORDER BY weight DESC, id) <= 400""")
def inverted_index(t):
    return X.inverted_index(_weighted(t), S.shard_of(F.col("term")))


@query(_INDEX + """, h AS (SELECT * FROM x JOIN d USING (term) WHERE term IN ('the', 'que', 'notaword')), k AS (SELECT count(DISTINCT term) AS known FROM h),
s AS (SELECT id, sum(weight * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df)) AS score, count(*) AS have FROM h GROUP BY id), f AS (SELECT count(*) FILTER (have = known) AS full_n FROM s, k)
SELECT id, round(score, 6) AS score, have FROM s, k, f WHERE known <= 1 OR full_n < 10 OR have = known""")
def index_rank(t):
    index = X.inverted_index(_weighted(t).where(F.col("term").isin("the", "que", "notaword")), S.shard_of(F.col("term")), postings=None)
    return X.rank_index(index, t.documents.count(), ["the", "que", "notaword"]).select("id", F.round("score", 6).alias("score"), "have")


# vectors --------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id)
SELECT id, neighbour, round(sim, 6) AS sim, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, neighbour) AS rank FROM p
QUALIFY rank <= 8""")
def exact_knn(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.knn(e, e, 8).select("id", "neighbour", F.round("sim", 6).alias("sim"), "rank")


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id, b.id AS n, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, n) <= 15),
v AS (SELECT k.id, e.label, sum(greatest(0, sim) ** 3) AS w FROM k JOIN e ON e.id = k.n GROUP BY ALL)
SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, label) = 1""")
def neighbour_vote(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return V.neighbour_vote(V.knn(e, e, 15), e).select("id", "label", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL)
SELECT label, dim::INT AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""")
def group_centroids(t):
    return V.centroids(t.embeddings, "label", "embedding").select("label", "dim", F.round("value", 6).alias("value"))


@query("""WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / scale + 0.5)))))::BIGINT AS q_sum FROM s""")
def int8_quantisation(t):
    q = t.embeddings.select("vec_id", V.quantise(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.q", F.lit(0), lambda a, x: a + x).cast("long").alias("q_sum"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_value FROM h""")
def truncated_vectors(t):
    return t.embeddings.select("vec_id", F.round(V.truncate(F.col("embedding"), 16)[0], 6).alias("first_value"))


@query()
def spherical_kmeans(t):
    return V.spherical_kmeans(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)


@query("""WITH o AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS p, label FROM embeddings)
SELECT label, round(avg(list_dot_product(v, p)), 6) AS adjacent FROM o WHERE p IS NOT NULL GROUP BY label""")
def adjacent_cosine(t):
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return t.embeddings.withColumn("p", before).where("p IS NOT NULL").groupBy("label").agg(F.round(F.avg(X.cosine(F.col("embedding"), F.col("p"))), 6).alias("adjacent"))


# time -------------------------------------------------------------------------------------------

#: Points, and ends that are known, of the sections of the page of 1997 and 1998.
SECTIONS = """x AS (SELECT *, kind <> 'span' OR "end" IS NULL OR "end" = start AS pt, CASE WHEN NOT open_ended THEN "end" END AS l FROM entries),
s AS (SELECT *, unnest([CASE WHEN pt AND start BETWEEN 1997 AND 1998 THEN 'happened' END, CASE WHEN NOT pt AND start BETWEEN 1997 AND 1998 THEN CASE WHEN person THEN 'born' ELSE 'began' END END,
CASE WHEN NOT pt AND l BETWEEN 1997 AND 1998 THEN CASE WHEN person THEN 'died' ELSE 'ended' END END,
CASE WHEN NOT pt AND start < 1997 AND l > 1998 AND (CASE WHEN person THEN 1998 - start >= 15 AND l - start <= 110 ELSE l - start < 2000 + 0.5 * 1997 END) THEN 'ongoing' END]) AS section FROM x)"""


@query(f"""WITH {ENTRIES}, {SECTIONS} SELECT id, section FROM s WHERE section IS NOT NULL""")
def date_page(t):
    return T.date_page(t.entries, 1997, 1998).select("id", "section")


@query(f"""WITH {ENTRIES} SELECT id FROM entries WHERE start <= 1999 AND CASE WHEN open_ended THEN 2026 ELSE coalesce("end", start) END >= 1998""")
def interval_overlap_filter(t):
    return t.entries.where(D.overlaps(F.col("start"), F.col("end"), 1998, 1999, F.col("open_ended"))).select("id")


@query(f"""WITH {ENTRIES} SELECT e.grp, count(*) AS n, count(DISTINCT e.id) AS spans FROM entries e JOIN (SELECT event_id, 1995 + event_id % 12 AS y FROM events) p ON p.y BETWEEN e.start AND e."end" WHERE e.kind = 'span' GROUP BY e.grp""")
def interval_join_counts(t):
    points = t.events.select("event_id", (1995 + F.col("event_id") % 12).alias("y")).groupBy("y").agg(F.count("*").alias("c"))
    spans = t.entries.where("kind = 'span'").select("id", "grp", "start", "end")
    return T.interval_join(points, "y", spans, "start", "end", 4).groupBy("grp").agg(F.sum("c").alias("n"), F.countDistinct("id").alias("spans"))


@query(f"""WITH {ENTRIES} SELECT a.id, b.id AS twin FROM entries a JOIN entries b ON a.grp = b.grp AND a.id < b.id AND abs(a.start - b.start) <= 1""")
def sorted_neighbourhood_pairs(t):
    e = t.entries.select("id", "grp", "start")
    other = e.select(F.col("id").alias("twin"), "grp", F.col("start").alias("y"))
    return T.band_join(e, other, "start", "y", 1, "grp").where("id < twin").select("id", "twin")


@query("""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, CASE WHEN floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) > 3600 THEN 1 ELSE 0 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM e) SELECT user_id, segment::BIGINT AS segment, count(*) AS n, max(s) - min(s) AS seconds FROM g GROUP BY ALL""")
def gap_segments(t):
    e = t.events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    g = T.segments(e, ["s", "event_id"], "s", 3600, "user_id")
    return g.groupBy("user_id", "segment").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("seconds"))


@query("""WITH RECURSIVE d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS r FROM orders GROUP BY 1),
w AS (SELECT day, r, 0::BIGINT AS bucket, n AS held FROM d WHERE r = 1 UNION ALL SELECT d.day, d.r, w.bucket + CASE WHEN w.held >= 500 THEN 1 ELSE 0 END, CASE WHEN w.held >= 500 THEN d.n ELSE w.held + d.n END FROM w JOIN d ON d.r = w.r + 1) SELECT day, bucket FROM w""")
def equal_time_buckets(t):
    counts = t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return T.equal_buckets(counts, "day", "n", 500)


@query(f"""WITH {ENTRIES}, b AS (SELECT range AS bucket, 1995 + range AS b_lo, 1995 + range AS b_hi FROM range(20)), m AS (SELECT e.id, b.bucket, count(*) OVER (PARTITION BY e.id) AS n FROM entries e JOIN b ON e.start <= b_hi AND coalesce(e."end", e.start) >= b_lo)
SELECT DISTINCT id, CASE WHEN n > 3 THEN -1 ELSE bucket END AS bucket FROM m""")
def span_replication(t):
    from almanack.sources.store import deal_to_buckets

    buckets = t.spark.range(20).select((F.col("id") + 1995).alias("lo"))
    return deal_to_buckets(t.entries.select("id", "start", "end"), buckets, F.coalesce("end", "start"), 3).select("id", F.col("bucket").cast("long").alias("bucket"))


@query(f"""WITH {ENTRIES} SELECT id, CASE WHEN person AND "end" IS NOT NULL THEN floor(start + ("end" - start) * 0.6 + 0.5) ELSE start END::BIGINT AS anchor, greatest(4, floor((2026 - start) * 0.035 + 0.5))::BIGINT AS around FROM entries""")
def anchors_and_windows(t):
    return t.entries.select("id", D.anchor_year(F.col("start"), F.col("end"), F.col("person")).alias("anchor"), D.meanwhile_window(F.col("start")).alias("around"))


# aggregation --------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, CASE WHEN n < 15 THEN 'Other ' || p_brand ELSE p_type END AS subject, sum(n)::BIGINT AS n FROM c GROUP BY ALL""")
def small_group_folding(t):
    c = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return c.groupBy("p_brand", F.when(F.col("n") < 15, F.concat(F.lit("Other "), "p_brand")).otherwise(F.col("p_type")).alias("subject")).agg(F.sum("n").alias("n"))


@query("""SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""")
def two_level_rollup(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT unnest([lang, source]) AS facet FROM documents) SELECT facet, count(*) AS n FROM f GROUP BY facet ORDER BY n DESC, facet LIMIT 10""")
def facet_counts(t):
    return t.documents.select(F.explode(F.array("lang", "source")).alias("facet")).groupBy("facet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet").limit(10)


@query(f"""WITH {TOKENS} SELECT w AS term, count(DISTINCT id) AS df FROM words WHERE w <> '' GROUP BY w HAVING count(DISTINCT id) >= 6 ORDER BY df DESC, term LIMIT 3000""")
def vocabulary(t):
    d = t.documents.select(F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return d.where("df >= 6").orderBy(F.desc("df"), "term").limit(3000)


@query(f"""WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents), g AS (SELECT lang, term, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL),
x AS (SELECT lang, term, n / sum(n) OVER (PARTITION BY lang) * ln(1 + sum(n) OVER () / sum(n) OVER (PARTITION BY term)) AS score FROM g)
SELECT lang, term, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) <= 20""")
def class_tfidf(t):
    g = keep(t.documents.select("lang", F.explode(plain_tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")))
    per_lang = g.groupBy("lang").agg(F.sum("n").alias("ln")).withColumn("total", F.sum("ln").over(Window.partitionBy()))  # a row for each language
    per_term = F.sum("n").over(Window.partitionBy("term"))
    x = g.withColumn("tn", per_term).join(F.broadcast(per_lang), "lang").withColumn("score", F.col("n") / F.col("ln") * F.log(1 + F.col("total") / F.col("tn")))
    w = Window.partitionBy("lang").orderBy(F.desc(F.round("score", 9)), "term")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 20").select("lang", "term", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, arg_max(lang, (n, lang)) AS lang, max(n) AS m, sum(n) AS total FROM c GROUP BY source) SELECT source, CASE WHEN m >= 0.6 * total THEN lang END AS dominant FROM s""")
def dominant_value(t):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    s = c.groupBy("source").agg(F.max(F.struct("n", "lang")).alias("m"), F.sum("n").alias("total"))
    return s.select("source", F.when(F.col("m.n") >= 0.6 * F.col("total"), F.col("m.lang")).alias("dominant"))


@query(f"""WITH {ENTRIES} SELECT grp, min(start) AS first_year, max(coalesce("end", start)) AS last_year, count(*) AS n, count(*) FILTER (open_ended) AS n_open FROM entries GROUP BY grp""")
def group_extents(t):
    return t.entries.groupBy("grp").agg(F.min("start").alias("first_year"), F.max(F.coalesce("end", "start")).alias("last_year"), F.count("*").alias("n"), F.count_if("open_ended").alias("n_open"))


@query(f"""WITH {ENTRIES} SELECT id, round(ln(1 + fame) / (SELECT ln(1 + max(fame)) FROM entries), 6) AS fame FROM entries""")
def log_fame(t):
    e = t.entries
    return e.join(F.broadcast(e.agg(F.max("fame").alias("top")))).select("id", F.round(F.log1p("fame") / F.log1p("top"), 6).alias("fame"))


@query("""WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS x FROM part GROUP BY p_brand) SELECT p_brand, x[len(x) // 2 + 1] AS median, x[floor(0.25 * (len(x) - 1))::INT + 1] AS q1, x[floor(0.75 * (len(x) - 1))::INT + 1] AS q3 FROM g""")
def index_quantiles(t):
    return K.at_ranks(t.part, "p_brand", "p_retailprice", median=F.floor(F.col("n") / 2), q1=K.middle(0.25), q3=K.middle(0.75)).drop("n")


@query("""WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS x FROM part GROUP BY p_brand), q AS (SELECT p_brand, x[floor(0.25 * (len(x) - 1))::INT + 1] AS q1, x[floor(0.75 * (len(x) - 1))::INT + 1] AS q3 FROM g WHERE len(x) >= 8),
o AS (SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN 920 - least(60, 1000) - 200 ELSE q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN p_brand LIKE '%1' THEN 980 + least(0.25 * 60, 200) + 50 ELSE q3 + 1.5 * (q3 - q1) END AS hi FROM q)
SELECT p_partkey FROM part JOIN o USING (p_brand) WHERE p_retailprice + p_size * 20 BETWEEN lo AND hi""")
def tukey_fence(t):
    own = F.when(F.endswith("p_brand", F.lit("1")), F.struct(F.lit(920.0).alias("start"), F.lit(980.0).alias("end")))
    q = K.at_ranks(t.part, "p_brand", "p_retailprice", q1=K.middle(0.25), q3=K.middle(0.75)).where("n >= 8")
    q = q.select("p_brand", T.era_fence(own, F.col("q1"), F.col("q3")).alias("f"))
    return t.part.join(q, "p_brand").where((F.col("p_retailprice") + F.col("p_size") * 20).between(F.col("f.lo"), F.col("f.hi"))).select("p_partkey")


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT l_partkey, list_sort(list(l_suppkey))::VARCHAR AS suppliers FROM m GROUP BY l_partkey HAVING count(*) >= 2""")
def membership_inversion(t):
    m = t.lineitem.groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s")).where(F.size("s") >= 2)
    return m.select("l_partkey", F.concat(F.lit("["), F.array_join(F.col("s").cast("array<string>"), ", "), F.lit("]")).alias("suppliers"))


@query("""WITH x AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL) SELECT * FROM p""")
def co_occurrence(t):
    groups = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(sqrt(avg(value * value)), 6) AS rmse, round(corr(value, epoch(ts)), 6) AS trend FROM events GROUP BY event_type""")
def rmse_and_trend(t):
    return t.events.groupBy("event_type").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rmse"), F.round(F.corr("value", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 6).alias("trend"))


@query("""WITH x AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) AS g FROM events),
r AS (SELECT user_id, ok, g, count(*) AS n FROM x GROUP BY ALL) SELECT user_id, coalesce(max(n) FILTER (ok), 0) AS best_streak, round(100.0 * coalesce(sum(n) FILTER (ok), 0) / sum(n), 4) AS right_pct FROM r GROUP BY user_id""")
def streak_summary(t):
    e = t.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    g = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "ok").orderBy("event_id"))
    r = e.withColumn("g", g).groupBy("user_id", "ok", "g").agg(F.count("*").alias("n"))
    right = F.when(F.col("ok"), F.col("n"))
    return r.groupBy("user_id").agg(F.coalesce(F.max(right), F.lit(0)).alias("best_streak"), F.round(100.0 * F.coalesce(F.sum(right), F.lit(0)) / F.sum("n"), 4).alias("right_pct"))


@query("""WITH r AS (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT p_type, min(p_size) AS lo, max(p_size) AS hi FROM r WHERE r > floor(0.04 * n) AND r <= n - floor(0.04 * n) GROUP BY p_type""")
def trimmed_extent(t):
    w = Window.partitionBy("p_type")
    r = t.part.select("p_type", "p_size", F.row_number().over(w.orderBy("p_size", "p_partkey")).alias("r"), F.count("*").over(w).alias("n"))
    return r.where("r > floor(0.04 * n) AND r <= n - floor(0.04 * n)").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("""SELECT n_name, sum(c)::BIGINT AS n, count(DISTINCT c_mktsegment) AS segments, round(max(c) * 1.0 / sum(c), 6) AS purity FROM (SELECT n_name, c_mktsegment, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_name""")
def group_purity(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("c"))
    return c.groupBy("n_name").agg(F.sum("c").alias("n"), F.count("*").alias("segments"), F.round(F.max("c") / F.sum("c"), 6).alias("purity"))


# windows and ranks -------------------------------------------------------------------------------

@query(f"""WITH {ENTRIES}, r AS (SELECT id, grp, fame, row_number() OVER (PARTITION BY grp ORDER BY fame DESC, id) AS r FROM entries), a AS (SELECT id FROM r WHERE r <= 3), b AS (SELECT id FROM r WHERE r > 3 ORDER BY fame DESC, id LIMIT 100) SELECT id, 'lane' AS why FROM a UNION ALL SELECT id, 'fill' FROM b""")
def top_per_group_and_overall(t):
    r = t.entries.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("fame"), "id")))
    a = r.where("r <= 3").select("id", F.lit("lane").alias("why"))
    return a.unionByName(r.where("r > 3").orderBy(F.desc("fame"), "id").limit(100).select("id", F.lit("fill").alias("why")))


@query(f"""WITH {ENTRIES} SELECT id, round(fame * CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY fame DESC, id) <= 2 THEN 0.92 ELSE 0.45 END, 4) AS damped FROM entries""")
def sibling_damping(t):
    r = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("fame"), "id"))
    return t.entries.select("id", F.round(F.col("fame") * F.when(r <= 2, 0.92).otherwise(0.45), 4).alias("damped"))


@query(f"""WITH {ENTRIES}, r AS (SELECT id, person, (row_number() OVER (PARTITION BY grp ORDER BY fame DESC, id) - 1) / greatest(1, count(*) OVER (PARTITION BY grp))::DOUBLE AS r FROM entries) SELECT id, r < CASE WHEN person THEN 0.22 ELSE 0.45 END AS full_card FROM r""")
def rank_tiers(t):
    w = Window.partitionBy("grp")
    r = (F.row_number().over(w.orderBy(F.desc("fame"), "id")) - 1) / F.greatest(F.lit(1), F.count("*").over(w))
    return t.entries.select("id", (r < F.when(F.col("person"), 0.22).otherwise(0.45)).alias("full_card"))


@query(f"""WITH {ENTRIES} SELECT id, sum(1 + id % 7) OVER w::BIGINT AS width, max(coalesce("end", start)) OVER w AS reach FROM entries WINDOW w AS (PARTITION BY grp ORDER BY start, id ROWS UNBOUNDED PRECEDING)""")
def running_bounds(t):
    w = Window.partitionBy("grp").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, 0)
    return t.entries.select("id", F.sum(1 + F.col("id") % 7).over(w).alias("width"), F.max(F.coalesce("end", "start")).over(w).alias("reach"))


@query(f"""WITH {ENTRIES}, r AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY start, id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM entries) SELECT id FROM r WHERE n <= 4 OR r IN (0, floor(n / 4), floor(2 * n / 4), floor(3 * n / 4))""")
def even_sample_per_group(t):
    w = Window.partitionBy("grp")
    r = t.entries.select("id", (F.row_number().over(w.orderBy("start", "id")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return r.where((F.col("n") <= 4) | F.exists(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("r") == F.floor(i * F.col("n") / 4))).select("id")


@query(f"""WITH {ENTRIES} SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM entries WINDOW w AS (PARTITION BY grp ORDER BY start, id)""")
def lane_steps(t):
    w = Window.partitionBy("grp").orderBy("start", "id")
    return t.entries.select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


# joins --------------------------------------------------------------------------------------------

@query("""SELECT doc_id, lang, coalesce(toxic::VARCHAR, 'Unclassified') AS label FROM documents LEFT JOIN labels USING (doc_id)""")
def labelled_or_unclassified(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("toxic").cast("string"), F.lit("Unclassified")).alias("label"))


@query("""SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)""")
def missing_labels(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("""SELECT p_partkey, coalesce(a.t, b.t) AS target FROM part LEFT JOIN (SELECT ps AS k, min(l_orderkey) AS t FROM (SELECT l_partkey AS ps, l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ps) a ON a.k = p_partkey LEFT JOIN (SELECT l_suppkey AS k, min(l_orderkey) AS t FROM lineitem GROUP BY l_suppkey) b ON b.k = p_size""")
def prioritised_lookup(t):
    l = t.lineitem
    first = l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("target"), F.col("l_orderkey").alias("seq"))
    second = l.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("target"), F.col("l_orderkey").alias("seq"))
    rows = t.part.select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return R.first_lookup(rows, [("p_partkey", first), ("p_size", second)]).select("p_partkey", "target")


@query(f"""WITH {ENTRIES} SELECT grp, arg_max(id, (fame, -id)) AS best FROM entries GROUP BY grp""")
def home_lane(t):
    return t.entries.groupBy("grp").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("best"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'hand' WHEN quality = 0 THEN 'model' ELSE 'base' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def override_layers(t):
    l = t.labels
    hand, model = l.where("toxic = 1").select("doc_id", F.lit("hand").alias("h")).distinct(), l.where("quality = 0").select("doc_id", F.lit("model").alias("m")).distinct()
    return t.documents.join(hand, "doc_id", "left").join(model, "doc_id", "left").select("doc_id", F.coalesce("h", "m", F.lit("base")).alias("verdict"))


# identity, gates, trees -------------------------------------------------------------------------

@query("""SELECT o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def dedupe_keep_richest(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")
    return R.keep_richest(rows, "o_custkey", F.desc("o_totalprice"), "id")[0].select("id")


@query("""SELECT text_id || CASE WHEN r > 1 THEN '~' || r ELSE '' END AS text_id, doc_id FROM (SELECT source || ':' || lang AS text_id, doc_id, row_number() OVER (PARTITION BY source || ':' || lang ORDER BY doc_id) AS r FROM documents)""")
def id_collisions(t):
    rows = t.documents.select(F.concat_ws(":", "source", "lang").alias("text_id"), "doc_id")
    return R.number_collisions(rows, "text_id", "doc_id")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey % 10 > 0), r AS (SELECT src, dst FROM c UNION ALL SELECT r.src, c.dst FROM r JOIN c ON r.dst = c.src) SELECT src, min(dst) AS dst FROM r GROUP BY src""")
def alias_chains(t):
    """Each customer but every tenth is another name of the one of half its number, along chains of up to as many links as it has bits."""
    return R.resolve_aliases(t.customer.where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst")))


@query("""WITH g AS (SELECT doc_id, text, CASE WHEN length(text) < 200 THEN 'short' WHEN lang = 'es' THEN 'language' END AS r FROM documents) SELECT CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, text ORDER BY doc_id) > 1 THEN 'repeated' ELSE coalesce(r, 'kept') END AS reason, count(*) AS n FROM g GROUP BY ALL""".replace("WITH g", "WITH g0 AS (SELECT 1), g").replace("SELECT CASE WHEN r IS NULL AND row_number", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r IS NULL AND row_number").replace("AS reason, count(*) AS n FROM g GROUP BY ALL", "AS reason FROM g) GROUP BY reason"))
def ingest_gates(t):
    gated = R.gates(t.documents, [("short", F.length("text") < 200), ("language", F.col("lang") == "es")], "text", "doc_id")
    return gated.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: A forest of all customers: five roots, three below each node.
FOREST = """n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 4 THEN (c_custkey - 5) // 3 END AS parent FROM customer)"""


def forest(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 4, F.expr("(c_custkey - 5) div 3")).alias("parent"))


@query(f"""WITH RECURSIVE {FOREST}, p AS (SELECT id, id AS root, 0 AS depth, id::VARCHAR AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.root, p.depth + 1, p.path || '/' || n.id FROM n JOIN p ON n.parent = p.id) SELECT * FROM p""")
def tree_paths(t):
    return R.tree_paths(forest(t)).select("id", "root", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"""WITH RECURSIVE {FOREST}, p AS (SELECT id, id AS top FROM n UNION ALL SELECT n.id, p.top FROM n JOIN p ON n.parent = p.id), c AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL) SELECT top AS id, sum(c.n)::BIGINT AS members FROM p JOIN c USING (id) GROUP BY top""")
def member_rollup(t):
    """The orders at or below each node of the forest."""
    c = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("members"))
    return R.roll_up(forest(t), c, members=F.sum)


@query(f"""WITH RECURSIVE {FOREST}, p AS (SELECT id, id AS top FROM n UNION ALL SELECT n.id, p.top FROM n JOIN p ON n.parent = p.id), c AS (SELECT o_custkey AS id, year(o_orderdate)::BIGINT AS a, year(o_orderdate)::BIGINT + o_orderkey % 5 AS z FROM orders)
SELECT top AS id, min(a) AS lo, max(z) AS hi, count(*) AS n FROM p JOIN c USING (id) GROUP BY top""")
def tree_extents(t):
    """The first and last years of all orders at or below each node of the forest, summed for each node before they go up."""
    y = F.year("o_orderdate").cast("long")
    own = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(y).alias("lo"), F.max(y + F.col("o_orderkey") % 5).alias("hi"), F.count("*").alias("n"))
    return R.roll_up(forest(t), own, lo=F.min, hi=F.max, n=F.sum)


# text ----------------------------------------------------------------------------------------------

@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w, source FROM documents), f AS (SELECT source, arg_min(w, doc_id) AS f FROM w GROUP BY source)
SELECT doc_id, round(len(list_intersect(w, f)) / (len(w) + len(f) - len(list_intersect(w, f)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(w, f)) / least(len(w), len(f))::DOUBLE, 6) AS overlap FROM w JOIN f USING (source) WHERE len(w) > 0 AND len(f) > 0""")
def title_overlap(t):
    w = t.documents.select("doc_id", "source", F.array_distinct(plain_tokens(F.col("text"))).alias("w"))
    f = w.groupBy("source").agg(F.min_by("w", "doc_id").alias("f"))
    j = w.join(f, "source").where((F.size("w") > 0) & (F.size("f") > 0))
    return j.select("doc_id", F.round(S.jaccard(F.col("w"), F.col("f")), 6).alias("jaccard"), F.round(S.overlap_coefficient(F.col("w"), F.col("f")), 6).alias("overlap"))


@query("""SELECT p_partkey, lower(p_brand) || ':' || CASE WHEN s = '' THEN 'x' ELSE s END || ':' || CASE WHEN p_size % 5 = 0 THEN 'nd' WHEN p_size % 5 = 1 THEN p_size || 'bc' ELSE p_size::VARCHAR END AS entry_id FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)""")
def entry_ids(t):
    year = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 5 == 1, -F.col("p_size")).otherwise(F.col("p_size"))
    return t.part.select("p_partkey", S.entry_id(F.lower("p_brand"), F.col("p_name"), year).alias("entry_id"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(left(text, 100), '\\s+\\S*$', '') END AS clipped FROM documents""")
def clipped_text(t):
    return t.documents.select("doc_id", S.clip(F.col("text"), 100).alias("clipped"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (v > 0) AS with_props FROM (SELECT event_type, length(props) AS v FROM events) GROUP BY ALL""")
def props_coverage(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.length("props") > 0).alias("with_props"))


# quality --------------------------------------------------------------------------------------------

@query(f"""WITH {ENTRIES} SELECT 'repeated id' AS rule, count(*) AS violations FROM (SELECT id FROM entries GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'no start', count(*) FROM entries WHERE start IS NULL UNION ALL SELECT 'backwards', count(*) FROM entries WHERE "end" < start
UNION ALL SELECT 'future', count(*) FROM entries WHERE greatest(start, coalesce("end", start)) > 2000 UNION ALL SELECT 'not unit length', count(*) FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1) > 0.02""")
def data_quality(t):
    e = t.entries
    row = e.agg(
        (F.count("id") - F.count_distinct("id")).alias("repeated id"), F.count_if(F.col("start").isNull()).alias("no start"),
        F.count_if(F.col("end") < F.col("start")).alias("backwards"), F.count_if(F.greatest("start", F.coalesce("end", "start")) > 2000).alias("future"),
    )
    rules = row.unpivot([], ["repeated id", "no start", "backwards", "future"], "rule", "violations")
    unit = F.abs(F.sqrt(X.cosine(F.col("embedding"), F.col("embedding"))) - 1) > 0.02
    return rules.unionByName(t.embeddings.agg(F.count_if(unit).alias("violations")).select(F.lit("not unit length").alias("rule"), "violations"))


# state ---------------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT user_id AS "user", event_type AS entry, epoch_ms(date_trunc('second', ts)) AS "at", event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS ok FROM events),
g AS (SELECT "user", entry, sum(ok)::BIGINT AS right_n, (count(*) - sum(ok))::BIGINT AS wrong_n, list_reduce(list(ok ORDER BY "at", event_id), lambda box, x: CASE WHEN x = 1 THEN least(6, box + 1) ELSE 0 END, 0)::INT AS box, max("at") AS "at" FROM e GROUP BY ALL)
SELECT *, "at" + [600000, 86400000, 259200000, 604800000, 1382400000, 3024000000, 7776000000][box + 1] AS due FROM g""")
def leitner_state(t):
    from almanack.streaming.progress import fold_reviews

    e = t.events.select(F.col("user_id").alias("user"), F.col("event_type").alias("entry"), F.unix_millis(F.date_trunc('second', F.col("ts").cast("timestamp"))).alias("at"), "event_id", (F.col("value") > 20).alias("right"))
    return fold_reviews(e)


@query("""WITH a AS (SELECT user_id, max(epoch_ms(date_trunc('second', ts))) AS at FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, max(epoch_ms(date_trunc('second', ts))) AS at FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, CASE WHEN b.at > coalesce(a.at, -1) THEN 'remote' ELSE 'local' END AS side, greatest(coalesce(a.at, b.at), coalesce(b.at, a.at)) AS at FROM a FULL JOIN b USING (user_id)""")
def last_writer_wins(t):
    from almanack.streaming.progress import merge_latest

    def side(kind):
        return t.events.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("key")).agg(F.max(F.unix_millis(F.date_trunc('second', F.col("ts").cast("timestamp")))).alias("at"))

    return merge_latest(side("view"), side("click")).select(F.col("key").alias("user_id"), "side", "at")


# beyond: what any engine must have -----------------------------------------------------------------

@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    l = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_windows(t):
    return t.events.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_millis(F.col("w.start").cast("timestamp")).alias("window_start"), "event_type", "n")


# more of the reference's operators ------------------------------------------------------------------

@query(f"""WITH {ENTRIES}, g AS (SELECT grp, list_sort(list(fame)) AS x FROM entries WHERE id % 7 <> 0 GROUP BY grp) SELECT id, round(CASE WHEN id % 7 = 0 THEN x[len(x) // 2 + 1] ELSE fame END, 2) AS fame FROM entries LEFT JOIN g USING (grp)""")
def median_imputation(t):
    e = t.entries.withColumn("known", F.when(F.col("id") % 7 != 0, F.col("fame")))
    g = K.at_ranks(e, "grp", "known", middle=F.floor(F.col("n") / 2))
    return e.join(g, "grp", "left").select("id", F.round(F.coalesce("known", "middle"), 2).alias("fame"))


@query(f"""WITH {ENTRIES} SELECT grp, count(*) FILTER ("end" < 1998) AS due, count(*) AS n, min("end") FILTER ("end" >= 1998) AS next_end FROM entries GROUP BY grp""")
def due_summary(t):
    return t.entries.groupBy("grp").agg(F.count_if(F.col("end") < 1998).alias("due"), F.count("*").alias("n"), F.min(F.when(F.col("end") >= 1998, F.col("end"))).alias("next_end"))


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Unique ' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 'List of ' || o_orderkey ELSE 'Page ' || o_custkey END END AS title FROM orders), n AS (SELECT title, count(*) AS n FROM m WHERE title IS NOT NULL GROUP BY title)
SELECT id, CASE WHEN m.title IS NULL THEN 'no-source' WHEN n > 1 THEN 'reused-page' WHEN m.title LIKE 'List of%' THEN 'index-page' ELSE 'review' END AS verdict FROM m LEFT JOIN n USING (title)""")
def reuse_verdicts(t):
    title = F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Unique ' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 'List of ' || o_orderkey ELSE 'Page ' || o_custkey END END")
    return R.miss_verdicts(t.orders.select(F.col("o_orderkey").alias("id"), title.alias("title"), F.lit(None).cast("string").alias("creator"))).select("id", "verdict")


@query(f"""WITH {ENTRIES}, r AS (SELECT id, grp, fame, CASE id % 6 WHEN 0 THEN 'event' WHEN 1 THEN 'person' WHEN 2 THEN 'place' WHEN 3 THEN 'work' WHEN 4 THEN 'event' ELSE 'person' END AS type, id % 12 = 2 AS headed FROM entries),
g AS (SELECT *, greatest(4, floor(0.3 * count(*) OVER (PARTITION BY grp) + 0.5)) AS quota, count(*) FILTER (type <> 'place' OR headed) OVER (PARTITION BY grp) AS usable, row_number() OVER (PARTITION BY grp ORDER BY fame DESC, id) AS o FROM r),
e AS (SELECT * FROM g WHERE type <> 'place' OR headed OR (usable = 0 AND o <= 2)),
s AS (SELECT *, CASE WHEN type = 'event' AND row_number() OVER (PARTITION BY grp, type = 'event' ORDER BY fame DESC, id) <= ceil(quota * 0.5) THEN 0 WHEN type = 'person' AND row_number() OVER (PARTITION BY grp, type = 'person' ORDER BY fame DESC, id) > ceil(quota * 0.4) THEN 2 ELSE 1 END AS stage FROM e)
SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY stage, fame DESC, id) <= quota""")
def quota_selection(t):
    kind = F.element_at(F.array(*map(F.lit, ["event", "person", "place", "work", "event", "person"])), (F.col("id") % 6 + 1).cast("int"))
    rows = t.entries.select("id", F.col("grp").alias("chapter"), kind.alias("type"), F.lit("Thing").alias("title"), F.col("fame").alias("importance"), (F.col("id") % 12 == 2).alias("headed"))
    n = F.count("*").over(Window.partitionBy("chapter"))
    return K.key_selection(rows.withColumn("n", n), 0.3 * F.col("n")).select("id")


@query("""SELECT r // 100 AS block, r % 100 AS place, o_orderkey AS id FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r, o_orderkey FROM orders)""")
def row_blocks(t):
    rows = K.numbered(t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"), F.desc("o_totalprice"), F.asc("id"))
    return rows.select(F.floor(F.col("n") / 100).alias("block"), (F.col("n") % 100).alias("place"), "id")


@query(f"""WITH {ENTRIES} SELECT 'a' AS side, id FROM entries WHERE status = 'F' UNION SELECT 'b', id FROM entries WHERE start >= 1998 EXCEPT SELECT 'b', id FROM entries WHERE person""")
def set_operations(t):
    e = t.entries
    both = e.where("status = 'F'").select(F.lit("a").alias("side"), "id").unionByName(e.where("start >= 1998").select(F.lit("b").alias("side"), "id")).distinct()
    return both.exceptAll(e.where("person").select(F.lit("b").alias("side"), "id").distinct())


@query(f"""WITH {ENTRIES}, p AS (SELECT a.id, b.id AS other, least(a."end", b."end") - greatest(a.start, b.start) AS shared, b.fame FROM entries a JOIN entries b ON a.grp = b.grp AND a.id <> b.id AND a.start <= b."end" AND b.start <= a."end" WHERE a.kind = 'span' AND b.kind = 'span')
SELECT id, arg_max(other, (100 * shared + fame / 1e6, -other)) AS best FROM p GROUP BY id""")
def overlap_ranking(t):
    s = t.entries.where("kind = 'span'")
    a, b = s.select("id", "grp", "start", "end"), s.select(F.col("id").alias("other"), "grp", F.col("start").alias("s"), F.col("end").alias("e"), "fame")
    p = T.overlap_join(a, b, "start", "end", "s", "e", 2, ("grp",)).where("id <> other")
    score = 100 * (F.least("end", "e") - F.greatest("start", "s")) + F.col("fame") / 1e6
    return p.groupBy("id").agg(F.max_by("other", F.struct(score, -F.col("other"))).alias("best"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM e) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS top_events FROM r WHERE r <= 6 GROUP BY user_id""")
def attached_neighbours(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = t.events.withColumn("r", F.row_number().over(w)).where("r <= 6")
    ordered = F.sort_array(F.collect_list(F.struct("r", F.col("event_id").cast("string").alias("e"))))
    return r.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ",").alias("top_events"))


@query("""SELECT user_id, session, min(epoch(date_trunc('second', ts))::BIGINT) AS began, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY ALL""")
def sessions(t):
    s = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("t0"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("t0")).cast("long")
    return s.select("user_id", r.alias("session"), F.unix_timestamp(F.date_trunc("second", F.col("t0").cast("timestamp"))).alias("began"), "n")


@query("""SELECT page_id, length(html) > 0 AS has_html, regexp_matches(html, '(?i)<script') AS has_script FROM pages""")
def page_flags(t):
    return t.pages.select("page_id", (F.length("html") > 0).alias("has_html"), F.col("html").rlike("(?i)<script").alias("has_script"))


def _page_sql() -> str:
    c = "html"
    for tag in ("script", "style", "nav", "header", "footer", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)</?(p|div|br|li|h[1-6]|tr|section|article|ul|ol|table)\\b[^>]*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')"
    return f"SELECT page_id, url, regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS text FROM pages"


@query(_page_sql())
def page_text(t):
    from almanack.sources.text import clean_html

    return t.pages.select("page_id", "url", clean_html(F.col("html")).alias("text"))


@query()
def found_dates(t):
    spans = per_text(D.text_dates, "array<struct<found: string, start: bigint, end: bigint>>")
    found = t.documents.select("doc_id", spans("text").alias("spans"))
    return found.select("doc_id", F.size("spans").alias("n"), F.array_min(F.transform("spans", lambda x: x["start"])).alias("first_year"), "spans")


@query("""SELECT conv_id, count(*) AS turns, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id""")
def conversation_summary(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.min_by("text", "turn").alias("first_text"))


@query(f"""WITH {ENTRIES} SELECT id, CASE WHEN start < 1996 THEN 'early' WHEN start < 1999 THEN 'middle' ELSE 'late' END AS era, CASE WHEN person THEN 20 ELSE 0 END + CASE WHEN kind = 'point' THEN 3 ELSE 0 END AS bonus FROM entries""")
def era_and_score(t):
    era = F.when(F.col("start") < 1996, "early").when(F.col("start") < 1999, "middle").otherwise("late")
    return t.entries.select("id", era.alias("era"), (F.when(F.col("person"), 20).otherwise(0) + F.when(F.col("kind") == "point", 3).otherwise(0)).alias("bonus"))
