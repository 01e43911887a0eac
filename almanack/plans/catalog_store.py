"""Queries of stores, layouts, readers, extraction, state, quizzes, quality and drawing, each with SQL that gives the same rows.

What they write goes to folders of their own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from almanack.functions import strings as S, when as W
from almanack.operators import extract as X, layout as L, quality as Q, quiz as Z, search as R
from almanack.plans.catalog import ENTRIES, query
from almanack.session import checkpoint_folder, spread
from almanack.sources import store as T, text as TX, web as B
from almanack.streaming import progress as P


def _folder(t) -> str:
    return f"{checkpoint_folder(t.spark)}/store-{uuid.uuid4().hex}"


# stores --------------------------------------------------------------------------------------------------


@query("""SELECT vec_id AS id, round(sum(abs(greatest(-127, least(127, floor(x / s + 0.5))) * s::FLOAT)), 4)::DOUBLE AS weight FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM embeddings) GROUP BY vec_id""")
def stored_vectors(t):
    path = _folder(t)
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    T.write_vectors(v.where("id % 2 = 0"), path)
    T.write_vectors(v.where("id % 2 = 1"), path)
    return T.read_vectors(t.spark, path).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("weight"))


@query("""SELECT c_mktsegment AS grp, count(*) AS n, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END)::BIGINT AS version_sum FROM customer GROUP BY ALL""")
def replaced_groups(t):
    path = _folder(t)
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("grp"))
    T.replace_group(rows.withColumn("version", F.lit(1)), path, "grp")
    T.replace_group(rows.where("grp = 'BUILDING'").withColumn("version", F.lit(2)), path, "grp")
    return t.spark.read.parquet(path).groupBy("grp").agg(F.count("*").alias("n"), F.sum("version").alias("version_sum"))


@query("""SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 5 <> 0""")
def swapped_tables(t):
    path = _folder(t)
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    T.replace(rows, path)
    T.replace(rows.where("id % 5 <> 0"), path)
    copy = f"{path}-published"
    T.publish(t.spark, path, copy)
    return t.spark.read.parquet(copy)


@query("""SELECT c_custkey AS id, c_name AS title, c_custkey % 3 = 0 AS appended FROM customer""")
def appended_entries(t):
    path = _folder(t)
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit("").alias("subtitle"), (F.col("c_custkey") % 3 == 0).alias("circa"))
    TX.write_entries(rows.where("NOT circa"), path, 200)
    T.append_entries(t.spark, rows.where("circa"), path, 200)
    return TX.read_entries(t.spark, path).select(F.col("id").cast("long").alias("id"), "title", F.col("circa").alias("appended"))


@query("""SELECT p_partkey AS id, p_name || ', "the ' || p_size || '"' AS title, '1990' AS year_text FROM part WHERE p_partkey % 2 = 0""")
def mapped_csv(t):
    path, k = _folder(t), F.col("p_partkey")
    rows = t.part.select(k.cast("string").alias("key"), F.concat("p_name", F.lit(', "the '), F.col("p_size").cast("string"), F.lit('"')).alias("name"), F.when(k % 2 == 0, "1990").alias("years"))
    T.write_csv(rows, path)
    T.write_csv(rows, path)  # the first version stays beside it
    read = TX.map_columns(TX.read_csv(t.spark, path), {"id": "key", "title": "name", "yearText": "years"})
    return read.select(F.col("id").cast("long").alias("id"), "title", F.col("yearText").alias("year_text"))


@query('''SELECT p_partkey AS id, p_partkey || ',"' || p_name || ', x","say ""hi"""' AS line FROM part''')
def csv_lines(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.csv_line(F.array(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(", x")), F.lit('say "hi"'))).alias("line"))


@query("""SELECT key, min(id) AS id FROM (SELECT lower(c_name) AS key, c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'alias ' || c_custkey % 100, c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY key""")
def ideas_by_name(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("Alias "), (F.col("c_custkey") % 100).cast("string")).alias("asked"), (F.col("c_custkey") % 7 == 0).alias("missing"))
    return T.ideas_by_name(rows)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'new' ELSE c_name END AS title, 1 AS rewritten FROM customer""")
def rewritten_chunks(t):
    """Two versions of a store that differ in one row: one chunk of eight is written again."""
    path = _folder(t)
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    T.rewrite_changed(rows, path, 8)
    again = T.rewrite_changed(rows.withColumn("title", F.when(F.col("id") == 7, "new").otherwise(F.col("title"))), path, 8)
    return t.spark.read.parquet(path).select("id", "title", F.lit(len(again)).alias("rewritten"))


@query("""SELECT s_suppkey AS id, s_name AS name, true AS found FROM supplier""")
def whole_documents(t):
    """One document of all suppliers, written whole; what isn't there yet is read as the empty one."""
    path = _folder(t)
    missing = T.read_document(t.spark, path, t.supplier.limit(0)).count()
    T.write_document(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return t.spark.read.json(path).select("id", "name", F.lit(missing == 0).alias("found"))


@query(f"""WITH {ENTRIES} SELECT id, start, CASE WHEN "end" <> start THEN "end" END AS "end", CASE WHEN kind = 'span' THEN 1 END AS span, CASE WHEN id % 2 = 0 THEN '~a/' || id ELSE NULL END AS image, CASE WHEN id % 3 = 0 THEN 'It was long.' END AS sentence, CASE WHEN id % 50 > 0 THEN least(9, floor(ln(1 + id % 50) + 0.5))::BIGINT END AS fame FROM entries""")
def lite_rows(t):
    e = t.entries
    rows = e.withColumns({
        "title": F.concat(F.lit("Thing "), F.col("id").cast("string")), "subtitle": F.lit("s"), "image": F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://up.example.org/a/"), F.col("id").cast("string"))),
        "excerpt": F.when(F.col("id") % 3 == 0, "It was long. Very.").otherwise(F.concat(F.lit("Thing "), F.col("id").cast("string"), F.lit(" was here. More."))), "sitelinks": (F.col("id") % 50).cast("int"),
    })
    lite = T.lite_rows(rows, e.select("id", F.array("topic").alias("topics")), "https://up.example.org/")
    return lite.select("id", "start", "end", "span", "image", "sentence", "fame")


# layouts -------------------------------------------------------------------------------------------------


def _layout(t) -> str:
    path = _folder(t)
    e = t.entries.withColumn("has_image", F.col("id") % 2 == 0).withColumn("topic", F.when(F.col("topic").rlike("^[12]"), F.col("topic")))
    T.write_layout(e, path, 300, 2026, words=S.index_tokens(F.concat_ws(" ", F.lit("order"), F.col("grp").cast("string"), "status")))
    return path


@query(f"""WITH {ENTRIES} SELECT id FROM entries WHERE start <= 1998 AND CASE WHEN open_ended THEN 2026 ELSE coalesce("end", start) END >= 1997""")
def served_time_range(t):
    return T.rows_between(t.spark, _layout(t), 1997, 1998, 2026)[0].select("id")


@query(f"""WITH {ENTRIES}, n AS (SELECT id, row_number() OVER (ORDER BY (topic LIKE '1%' OR topic LIKE '2%') DESC, fame DESC, id % 2, id) - 1 AS n FROM entries) SELECT n, id FROM n WHERE n IN (0, 7, 150, 151, 1200)""")
def served_rows(t):
    path = _layout(t)
    numbers = t.spark.createDataFrame([(n,) for n in (0, 7, 150, 151, 1200)], "n long")
    return T.rows_by_number(t.spark, path, numbers).select("n", "id")


@query(f"""WITH {ENTRIES}, n AS (SELECT id, grp, status, row_number() OVER (ORDER BY (topic LIKE '1%' OR topic LIKE '2%') DESC, fame DESC, id % 2, id) - 1 AS n FROM entries), h AS (SELECT n FROM n WHERE grp = 12) SELECT n, round(0.455 * ln(1 + (SELECT count(*) FROM entries)::DOUBLE / (SELECT count(*) FROM h)) + CASE WHEN (SELECT count(*) FROM h) < 10 THEN 0 ELSE 0 END, 6) AS score FROM h""")
def served_words(t):
    return T.find_rows(t.spark, _layout(t), "12 of the unknownword", 10_000).select("n", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT n_nationkey AS bucket, n_nationkey * 100 AS lo, n_nationkey * 100 + 99 AS hi FROM nation WHERE n_nationkey NOT IN (10, 11)) SELECT bucket FROM b WHERE lo <= 2000 AND hi >= 500 ORDER BY abs((lo + hi) / 2.0 - 1250), bucket LIMIT 10""")
def buckets_to_load(t):
    bounds = t.nation.select(F.col("n_nationkey").alias("bucket"), (F.col("n_nationkey") * 100).alias("lo"), (F.col("n_nationkey") * 100 + 99).alias("hi"))
    return T.buckets_to_load(bounds, bounds.where("bucket IN (10, 11)"), 500, 2000).select("bucket")


@query("""SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page FROM orders""")
def upsert_pages(t):
    return T.pages_of(t.orders.select(F.col("o_orderkey").alias("id")), "id")


# retrieval with the real tokenizers --------------------------------------------------------------------------

_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END"


@query(f"""WITH x AS (SELECT doc_id AS id, source || ' ' || source || ' ' || lang || ' ' || left(text, 1500) AS text FROM documents), w AS (SELECT id, unnest(regexp_split_to_array(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]+')) AS w FROM x),
k AS (SELECT id, {_STEM} AS w FROM w WHERE (length(w) > 1 OR regexp_matches(w, '[0-9]')) AND w NOT IN ({", ".join(f"'{w}'" for w in S.SEARCH_STOP)})),
dl AS (SELECT x.id, count(w) AS dl FROM x LEFT JOIN k USING (id) GROUP BY x.id), s AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), h AS (SELECT id, w, count(*) AS tf FROM k WHERE w IN ('onhe', 'src1', 'tion') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM h GROUP BY w)
SELECT h.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM h JOIN df USING (w) JOIN dl USING (id), s GROUP BY h.id HAVING count(*) >= 2""")
def bm25_stemmed(t):
    from almanack.functions.text import doc_text

    none = F.array().cast("array<string>")
    text = doc_text(F.col("source"), F.col("lang"), none, F.create_map(F.lit("none"), none), F.coalesce("text", F.lit("")))
    return R.bm25(t.documents, "doc_id", S.tokenize(text), ["onhe", "src1", "tion"]).select("id", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS w, 3.0::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, lower(p_type), 1.0::DOUBLE FROM part UNION ALL SELECT p_partkey, unnest(['cold', 'thing']), 0.6::DOUBLE FROM part),
g AS (SELECT id, CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END AS term, sum(x) AS f FROM f GROUP BY ALL)
SELECT id, term, round(f / (f + 1.2::DOUBLE) * ((1 + CASE WHEN id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + 0.08::DOUBLE * (id % 9)) * CASE WHEN len(string_split(p_name, ' ')) <= 3 THEN 1.15::DOUBLE ELSE 1 END), 3) AS weight FROM g JOIN part ON p_partkey = id""")
def weighted_terms(t):
    rows = t.part.withColumn("id", F.col("p_partkey"))
    fields = [(S.index_tokens(F.col("p_name")), 3.0), (S.index_tokens(F.col("p_type")), 1.0), (S.index_tokens(F.lit("The cold thing")), 0.6)]
    boost = 1 + F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.0) + 0.08 * (F.col("id") % 9)
    return R.weighted_terms(rows, fields, boost, F.size(S.index_tokens(F.col("p_name"))) <= 3)


@query("""SELECT p_partkey AS id FROM part WHERE (contains(p_name, 'cold') AND contains(p_name, 'widget')) OR p_size = 7""")
def atlas_search(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return R.index_or_title(rows.where("p_size = 7"), rows, F.col("p_name"), ["Cold", "widget"])


# readers -------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT n_nationkey // 3 AS category, n_nationkey AS member, n_nationkey % 2 = 0 AS sub FROM nation WHERE n_nationkey > 0), c AS (SELECT 0 AS category, 0 AS depth UNION ALL SELECT e.member, c.depth + 1 FROM c JOIN e ON e.category = c.category AND sub WHERE c.depth < 3 AND e.member <> 0)
SELECT member AS page, min(depth)::INT AS depth FROM c JOIN e ON e.category = c.category AND NOT sub GROUP BY member""")
def category_crawl(t):
    edges = t.nation.where("n_nationkey > 0").select(F.expr("n_nationkey div 3").cast("int").alias("category"), F.col("n_nationkey").alias("member"), (F.col("n_nationkey") % 2 == 0).alias("is_category"))
    return B.crawl(edges, t.nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("category")), 3, 1000)


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'body of ' || n_nationkey END AS body FROM nation""")
def patient_fetch(t):
    """A service that refuses each address once, fails for a while, and doesn't know some."""
    asked: dict[str, int] = {}

    def fetch(url: str):
        asked[url] = asked.get(url, 0) + 1
        n = int(url.rsplit("/", 1)[1])
        return (404, None) if n % 4 == 0 else (429, None) if asked[url] == 1 else (500, None) if asked[url] == 2 else (200, f"body of {n}")

    urls = t.nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("http://x/"), "n_nationkey").alias("url"))
    return B.fetch_all(urls, "url", fetch, B.Patience(sleep=lambda s: None)).select("id", "body")


@query("""SELECT 'Category ' || p_partkey AS source, CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE '' END AS domain, CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE 2 END::INT AS depth, CASE WHEN p_partkey % 4 = 1 THEN 200 ELSE 500 END::INT AS "limit" FROM part WHERE p_partkey % 4 IN (1, 2) AND p_partkey % 7 <> 0""")
def crawl_list(t):
    """A line for each part: a comment, a whole one, a name with a remark, nothing; a seventh of the sources is done."""
    path, k = _folder(t), F.col("p_partkey")
    name = F.concat(F.lit("Category "), k.cast("string"))
    line = F.when(k % 4 == 0, F.concat(F.lit("# "), name)).when(k % 4 == 1, F.concat_ws(" | ", name, "p_type", F.col("p_size").cast("string"), F.lit("200"))).when(k % 4 == 2, F.concat(name, F.lit("  # people"))).otherwise("")
    t.part.select(line.alias("value")).write.text(path)
    return B.read_crawl_list(t.spark, path, t.part.where("p_partkey % 7 = 0").select(name.alias("source")))


@query("""SELECT unnest(CASE p_partkey % 3 WHEN 1 THEN ['Timeline of ' || p_name] WHEN 2 THEN [p_size || ' in ' || p_name, (p_size + 1) || ' in ' || p_name] ELSE [] END) AS name, CASE p_partkey % 3 WHEN 1 THEN '{events: [' || p_size || ' in film, ' || p_type || ']}' ELSE '{}' END AS options FROM part""")
def job_list(t):
    """A line for each part: a comment, a page with options, a range of years."""
    path, k, n = _folder(t), F.col("p_partkey"), F.col("p_size")
    line = F.when(k % 3 == 0, F.concat(F.lit("# "), "p_name")).when(k % 3 == 1, F.concat(F.lit("Timeline of "), "p_name", F.lit(" | events="), n.cast("string"), F.lit(" in film; "), "p_type"))
    t.part.select(F.coalesce(line, F.concat(n.cast("string"), F.lit(".."), (n + 1).cast("string"), F.lit(" in "), "p_name")).alias("value")).write.text(path)
    jobs = TX.read_job_list(t.spark, path)
    said = F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(": ["), F.array_join(e["value"], ", "), F.lit("]")))
    return jobs.select("name", F.concat(F.lit("{"), F.array_join(F.filter(said, lambda x: ~x.rlike("^:")), ", "), F.lit("}")).alias("options"))


@query("""SELECT 'Fall of ' || p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 2 = 0 THEN (400 + p_size)::VARCHAR END AS year_text, 'It fell.' || chr(10) || 'Size ' || p_size AS body FROM part""")
def text_blocks(t):
    """A block for each part, every other one with its year."""
    path, k = _folder(t), F.col("p_partkey")
    year = F.when(k % 2 == 0, F.concat(F.lit("year: "), (400 + F.col("p_size")).cast("string")))
    block = F.concat(F.concat_ws("\n", F.concat(F.lit("Fall of "), "p_name", F.lit(" "), k.cast("string")), year, F.lit("It fell."), F.concat(F.lit("Size "), F.col("p_size").cast("string"))), F.lit("\n"))
    t.part.select(block.alias("value")).write.text(path)
    return TX.read_blocks(t.spark, path)


@query("""SELECT 'History of Land ' || n_nationkey AS title, 30000 + 1000 * n_nationkey AS size FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 ORDER BY size DESC LIMIT 6""")
def discovered_topics(t):
    titles = t.nation.select(F.concat(F.lit("Land "), "n_nationkey").alias("title"))
    page = F.concat(F.lit("History of Land "), "n_nationkey")
    pages = t.nation.select(page.alias("title"), F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("Land "), "n_nationkey")).alias("target"), (30_000 + 1000 * F.col("n_nationkey")).alias("size"))
    listed = t.nation.where("n_nationkey % 4 = 0").select(F.upper(page).alias("title"))
    return B.discover(titles, pages, listed, "History of {}", "land", 40_000, 6)


@query("""SELECT 'http://s/a/' || c_custkey || '.html' AS url, floor(log2(c_custkey + 1))::INT AS level FROM customer WHERE c_custkey >= 0 AND c_custkey < 127""")
def site_pages(t):
    """Each customer's page links the two below it, the one above it and another site; six levels from the first."""
    k = F.col("c_custkey")
    link = lambda x, place="": F.concat(F.lit('<a href="'), F.lit(place), x.cast("string"), F.lit('.html#top">x</a>'))
    html = F.concat(link(2 * k + 1), link(2 * k + 2, "./"), link(F.floor((k - 1) / 2)), F.lit('<a href="http://other/">o</a>'))
    return B.read_site(t.customer.select(F.concat(F.lit("http://s/a/"), k.cast("string"), F.lit(".html")).alias("url"), html.alias("html")), "http://s/a/0.html", 6)


@query("""SELECT n_nationkey AS id, (n_nationkey * n_nationkey)::VARCHAR AS result FROM nation""")
def bounded_calls(t):
    return B.bounded_map(t.nation.select(F.col("n_nationkey").alias("id")), lambda x: int(x) * int(x), "id")


# extraction ----------------------------------------------------------------------------------------------

_HTML = """<p>Lead text about <a href="/wiki/Rome">Rome</a> that is long enough to stay.</p><table class="infobox"><tr><td><a href="/wiki/Box">x</a></td></tr></table>
<h2>History</h2><div class="hatnote">Main article: <a href="/wiki/Ancient_Rome">Ancient Rome</a></div><p>In   the year 500 <a href="/wiki/Odoacer">Odoacer</a> ruled all of it.<sup class="reference"><a href="/wiki/Note">1</a></sup></p>
<h3>Kings</h3><ul><li>short</li></ul><h2>References</h2><p><a href="/wiki/Gone">Gone</a> and many more words that do not count.</p><h3>Sub</h3><h2>Legacy</h2><p>What is <b>left</b> of it, in words &amp; stones, is here.</p>"""


@query("""SELECT p_partkey AS id, level, title, links, paras FROM part, (VALUES (1, '(lead)', 'Rome:1', 1), (2, 'History', 'Ancient Rome:4 Odoacer:1', 1), (3, 'Kings', '', 0), (2, 'Legacy', '', 1)) v(level, title, links, paras)""")
def article_sections(t):
    rows = spread(t.part).select(F.col("p_partkey").alias("id"), F.explode(X.sections(F.concat(F.lit(_HTML), F.lit("<!--"), F.col("p_partkey").cast("string"), F.lit("-->")))).alias("s"))
    links = F.array_join(F.transform("s.links", lambda x: F.concat(x["target"], F.lit(":"), x["weight"].cast("string"))), " ")
    return rows.select("id", "s.level", "s.title", links.alias("links"), F.size("s.paras").alias("paras"))


@query("""SELECT p_partkey AS id, 'In the year ' || (p_partkey + 100) || ' ' || p_name || ' & ' || p_type || ' ruled all.' AS text, target, CASE WHEN target = p_name THEN 13 + length((p_partkey + 100)::VARCHAR) ELSE 16 + length((p_partkey + 100)::VARCHAR) + length(p_name) END::INT AS place FROM (SELECT *, unnest([p_name, p_type]) AS target FROM part)""")
def prose_links(t):
    k = F.col("p_partkey").cast("string")
    link = lambda c: F.concat(F.lit('<a href="/wiki/'), F.replace(c, F.lit(" "), F.lit("_")), F.lit('">'), c, F.lit("</a>"))
    html = F.concat(F.lit("In   the year "), (F.col("p_partkey") + 100).cast("string"), F.lit(" "), link(F.col("p_name")), F.lit(" &amp; "), link(F.col("p_type")), F.lit('<sup class="reference"><a href="/wiki/N">1</a></sup> ruled\nall.'))
    p = spread(t.part).select(F.col("p_partkey").alias("id"), X.prose(html).alias("p"))
    return p.select("id", "p.text", F.explode("p.links").alias("l")).select("id", "text", "l.target", F.col("l.at").alias("place"))


@query("""SELECT p_partkey AS page_id, 'Kings of ' || p_name AS heading, start, start + p_partkey % 3 AS "end", text FROM (SELECT *, 1000 + p_partkey % 800 AS start, unnest(['The battle of ' || p_type || ' took place', 'The crown of ' || p_type || ' was taken there', 'One more thing over two cells there']) AS text FROM part)""")
def table_events(t):
    """A table under a heading on each part's page, a date over three rows and a text over two columns; a table without a class is none."""
    y = 1000 + F.col("p_partkey") % 800
    when = F.when(F.col("p_partkey") % 3 == 0, y.cast("string")).otherwise(F.concat(y.cast("string"), F.lit("–"), (y + F.col("p_partkey") % 3).cast("string")))
    html = F.concat(
        F.lit("<h2>Kings of "), "p_name", F.lit(' [edit]</h2><table class="wikitable"><tr><th>Year</th><th>Event</th><th>x</th></tr><tr><td rowspan=3>'), when, F.lit("</td><td>The battle of "), "p_type",
        F.lit(" took place</td><td>1</td></tr><tr><td>The crown of "), "p_type", F.lit(" was taken there</td><td>2</td></tr><tr><td colspan=2>One more thing over two cells there</td></tr></table><table><tr><td>1066</td><td>plain</td></tr></table>"),
    )
    return X.headed_table_events(spread(t.part).select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""SELECT p_partkey AS page_id, 1000 + p_partkey % 800 AS start, 'The battle of ' || p_name AS text FROM part""")
def mined_tables(t):
    from almanack.operators.tables import mine_tables

    html = F.concat(F.lit("<table><tr><th>Year</th><th>Event</th></tr><tr><td>"), (1000 + F.col("p_partkey") % 800).cast("string"), F.lit("</td><td>The battle of "), "p_name", F.lit("</td></tr></table>"))
    return mine_tables(spread(t.part).select(F.col("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "start", "text")


@query("""SELECT p_partkey AS page_id, heading, target FROM (SELECT p_partkey, unnest(['', 'Kings', 'Kings', 'Wars']) AS heading, unnest([p_name, 'Romulus ' || p_partkey, 'Numa', p_type]) AS target FROM part)""")
def box_members(t):
    """A box on each part's page: a title, two headings with their links, one of them again in a table within."""
    name, brand = (F.replace(c, F.lit(" "), F.lit("_")) for c in ("p_name", "p_type"))
    html = F.concat(
        F.lit('<div class="x"></div><table class="sidebar"><tr><th class="sidebar-title"><a href="/wiki/'), name, F.lit('">T</a></th></tr><tr><th class="sidebar-heading">Kings</th></tr><tr><td><a href="/wiki/Romulus_'), F.col("p_partkey").cast("string"),
        F.lit('">R</a> <a href="/wiki/Numa">N</a><table><tr><td><a href="/wiki/'), name, F.lit('">again</a></td></tr></table></td></tr><tr><th class="sidebar-heading">Wars</th></tr><tr><td><a href="/wiki/'), brand, F.lit('">P</a></td></tr></table><a href="/wiki/Outside">o</a>'),
    )
    return X.box_members(spread(t.part).select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS year, year(o_orderdate) || ' – Team ' || o_custkey || ' win the cup' || CASE WHEN o_orderkey % 2 = 0 THEN ', beating Team 0 ' || (o_orderkey % 9) || '–0' ELSE '' END || '.' AS sentence FROM orders WHERE o_orderkey % 5 <> 0""")
def result_sentences(t):
    k = F.col("o_orderkey")
    winner = F.when(k % 10 == 0, "Not held").when(k % 5 == 0, "—").otherwise(F.concat(F.lit("Team "), F.col("o_custkey").cast("string")))
    rows = t.orders.select(k.alias("id"), F.year("o_orderdate").cast("string").alias("year_text"), winner.alias("winner"), F.when(k % 2 == 0, "Team 0").alias("loser"), F.concat((k % 9).cast("string"), F.lit("–0")).alias("score"))
    return X.results(rows, "the cup").select("id", "year", "sentence")


@query("""SELECT (1700 + p_partkey % 320)::BIGINT AS year, unnest([p_name || ' ' || p_partkey || ' wins the open', 'R' || p_partkey || ' wins the masters']) AS title FROM part WHERE p_partkey % 9 <> 0""")
def column_winners(t):
    rows = t.part.selectExpr("CAST(1700 + p_partkey % 320 AS STRING) AS y", "CASE WHEN p_partkey % 9 = 0 THEN 'Cancelled' ELSE p_name || ' ' || p_partkey || ' (2/3)' END AS a", "CASE WHEN p_partkey % 9 = 0 THEN 'None' ELSE 'R' || p_partkey END AS b")
    return X.column_winners(rows, "y", {"a": "the open", "b": "the masters"}, one=True)


@query("""SELECT p_partkey AS id, round(1 / (1 + least(abs(p_size - 10), abs(p_size - 30)) / 6.0) + CASE WHEN p_size BETWEEN 10 AND 30 THEN 0.25 ELSE 0 END + 0.06 + 0.1 - least(0.35, 0.12 * (p_partkey % 5)), 6)::DOUBLE AS score FROM part""")
def paragraph_scores(t):
    score = X.paragraph_score(F.array(F.lit(10), F.lit(30)), F.col("p_size"), F.lit(0.1), F.col("p_partkey") % 5)
    return t.part.select(F.col("p_partkey").alias("id"), F.round(score, 6).alias("score"))


_PARAGRAPHS = """p AS (SELECT p_partkey % 300 AS page, p_partkey AS paragraph, [1993 + p_size % 12, 1993 + p_size % 12 + p_partkey % 4] AS years, (p_partkey % 9) / 40 AS weight FROM part),
e AS (SELECT o_custkey % 300 AS page, o_orderkey AS id, year(o_orderdate) AS y FROM orders)"""


@query(f"""WITH {_PARAGRAPHS}, ps AS (SELECT page, list({{p: paragraph, lo: years[1], hi: years[2], w: weight::DOUBLE}} ORDER BY paragraph) AS ps FROM p GROUP BY page),
es AS (SELECT page, list(id ORDER BY y, id) AS ids, list([y] ORDER BY y, id) AS ys FROM e GROUP BY page),
f AS (SELECT ids, list_reduce(ys, lambda acc, x: list_append(acc, -list_max(list_transform(ps, lambda q: struct_pack(s := round(1 / (1 + least(abs(q.lo - x[1]), abs(q.hi - x[1])) / 6)
+ CASE WHEN q.hi > q.lo AND x[1] BETWEEN q.lo AND q.hi THEN 0.25 ELSE 0 END + 0.06 + q.w - least(0.35, 0.12 * len(list_filter(acc, lambda o: o = q.p))), 9), m := -q.p))).m), []::BIGINT[]) AS got FROM es JOIN ps USING (page))
SELECT unnest(ids) AS id, unnest(got) AS paragraph FROM f""")
def assigned_paragraphs(t):
    entries = t.orders.select((F.col("o_custkey") % 300).alias("page"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    first = 1993 + F.col("p_size") % 12
    paras = t.part.select((F.col("p_partkey") % 300).alias("page"), F.col("p_partkey").alias("paragraph"), F.array(first, (first + F.col("p_partkey") % 4).cast("int")).alias("years"), ((F.col("p_partkey") % 9) / 40).alias("weight"))
    return X.assign_paragraphs(entries, paras)


# Each order may take one of three pages of its customer's nation; few pages, so that many find theirs spent.
_WANTS = """w AS (SELECT o_orderkey AS id, o_custkey % 25 AS g, [o_orderkey % 40, (o_orderkey * 7 + 1) % 90, o_orderkey % 11 + 100] AS pages FROM orders)"""


@query(f"""WITH {_WANTS}, l AS (SELECT list(id ORDER BY id) AS ids, list(pages ORDER BY id) AS xs FROM w GROUP BY g),
f AS (SELECT ids, list_reduce(xs, lambda acc, x: list_append(acc, coalesce(list_filter(x, lambda p: len(list_filter(acc, lambda o: o = p)) < 3)[1], -1)), []::BIGINT[]) AS got FROM l)
SELECT * FROM (SELECT unnest(ids) AS id, unnest(got) AS page FROM f) WHERE page >= 0""")
def reuse_capped(t):
    k = F.col("o_orderkey")
    rows = t.orders.select((F.col("o_custkey") % 25).alias("group"), k.alias("id"), k.alias("seq"), F.array(k % 40, (k * 7 + 1) % 90, k % 11 + 100).alias("pages"))
    return X.capped_choice(rows)


@query("""WITH d AS (SELECT doc_id AS id, lang, trim(text) AS excerpt, length(trim(text)) < 300 AS thin, [doc_id % 40, doc_id % 23, doc_id % 17 + 50] AS pages FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id AS page, left(text, 600) AS text FROM documents WHERE length(left(text, 600)) >= 120), ok AS (SELECT list(page) AS ok FROM g),
l AS (SELECT lang, list(id ORDER BY id) AS ids, list(list_filter(pages, lambda p: list_contains(ok, p)) ORDER BY id) AS xs FROM d, ok WHERE thin GROUP BY lang),
f AS (SELECT ids, list_reduce(xs, lambda acc, x: list_append(acc, coalesce(list_filter(x, lambda p: len(list_filter(acc, lambda o: o = p)) < 3)[1], -1)), []::BIGINT[]) AS got FROM l),
c AS (SELECT * FROM (SELECT unnest(ids) AS id, unnest(got) AS context FROM f) WHERE context >= 0)
SELECT d.id, context, md5(CASE WHEN context IS NULL THEN d.excerpt ELSE trim(d.excerpt || chr(10) || chr(10) || g.text) END) AS excerpt FROM d LEFT JOIN c USING (id) LEFT JOIN g ON g.page = context""")
def thickened_excerpts(t):
    """Short documents take the beginning of one of three others, each of which may be taken three times in a language."""
    k = F.col("doc_id")
    docs = t.documents.where("text IS NOT NULL")
    drafts = docs.select(F.col("lang").alias("group"), k.alias("id"), k.alias("seq"), F.trim("text").alias("excerpt"), F.array(k % 40, k % 23, k % 17 + 50).alias("pages"))
    return X.thickened(drafts, docs.select(k.alias("page"), "text")).select("id", "context", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"))


# state ---------------------------------------------------------------------------------------------------

_REVIEWS = """e AS (SELECT user_id AS "user", event_type AS entry, epoch_ms(date_trunc('second', ts)) AS "at", event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS ok FROM events)"""


@query(f"""WITH {_REVIEWS} SELECT "user", entry, sum(ok)::BIGINT AS right_n, (count(*) - sum(ok))::BIGINT AS wrong_n, list_reduce(list(ok ORDER BY "at", event_id), lambda b, x: CASE WHEN x = 1 THEN least(6, b + 1) ELSE 0 END, 0)::INT AS box FROM e GROUP BY ALL""")
def streamed_reviews(t):
    """The states after a stream of three batches over which the reviews are dealt by a hash, so that most come late."""
    path = _folder(t)
    e = _reviews(t)
    for i in range(3):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(e.schema).parquet(f"{path}/in")
        P.stream_reviews(stream, f"{path}/states", f"{path}/progress").awaitTermination()
    last = max(i for i in range(10) if T.exists(t.spark, f"{path}/states/{i}"))
    return P.boxes(t.spark.read.parquet(f"{path}/states/{last}")).select("user", "entry", "right_n", "wrong_n", "box")


def _reviews(t):
    return t.events.select(F.col("user_id").alias("user"), F.col("event_type").alias("entry"), F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"), "event_id", (F.col("value") > 20).alias("right"))


@query(f"""WITH {_REVIEWS}, s AS (SELECT "user", entry, max("at") AS "at", sum(ok)::BIGINT AS right_n, list_reduce(list(ok ORDER BY "at", event_id), lambda b, x: CASE WHEN x = 1 THEN least(6, b + 1) ELSE 0 END, 0)::INT AS box FROM e GROUP BY ALL),
d AS (SELECT *, "at" + CASE box WHEN 0 THEN 600000 ELSE 86400000::BIGINT * [1, 3, 7, 16, 35, 90][box] END AS due FROM s) SELECT "user", entry, right_n, box, due::BIGINT AS due FROM d WHERE due <= (SELECT max("at") FROM e) + 40 * 86400000::BIGINT""")
def due_notices(t):
    """What event-time timers have fired by 40 days after the last review, of reviews that come in no order: a due time that a later or a late
    answer has moved fires once, at its new time."""
    path = _folder(t)
    e = _reviews(t).withColumn("ts", F.timestamp_millis("at"))
    beat = e.agg(F.max("at").alias("m")).select(F.lit(-1).cast(dict(e.dtypes)["user"]).alias("user"), F.lit("clock").alias("entry"), F.col("m").alias("at"), F.lit(-1).cast("long").alias("event_id"), F.lit(True).alias("right"), F.timestamp_millis(F.col("m") + 100 * 86_400_000).alias("ts"))
    spark, setting = t.spark, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (*(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)), beat):
            part.write.mode("append").parquet(f"{path}/in")
            notices = P.review_notices(spark.readStream.schema(e.schema).parquet(f"{path}/in"))
            notices.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.parquet(f"{path}/out").where("what = 'due' AND user >= 0").select("user", "entry", "right_n", "box", "due")


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS "at", ['a'] AS x FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT CASE WHEN c_custkey % 9 = 1 THEN c_custkey + 1 ELSE c_custkey END AS id, max(c_custkey % 25) AS "at" FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)
SELECT id, CASE WHEN a."at" IS NULL OR b."at" > a."at" THEN b."at" ELSE a."at" END::BIGINT AS "at", CASE WHEN a.id IS NULL THEN 'b' WHEN b."at" > a."at" THEN 'b,a' ELSE 'a' END AS topics, b.id IS NULL OR coalesce(a."at" > b."at", false) AS push FROM a FULL JOIN b USING (id)""")
def merged_records(t):
    local = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("at"), F.array(F.lit("a")).alias("topics"))
    remote = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("at"), F.array(F.lit("b")).alias("topics"))
    aliases = t.customer.where("c_custkey % 9 = 1").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    merged, push = P.merge_records(local, remote, aliases)
    return merged.join(push.select("id", F.lit(True).alias("_p")), "id", "left").select("id", "at", F.array_join("topics", ",").alias("topics"), F.coalesce("_p", F.lit(False)).alias("push"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0""")
def unfinished_jobs(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"))
    return P.unfinished(jobs, jobs.where("id % 4 = 0"), jobs.where("id % 7 = 0"))


@query("""SELECT c_custkey AS name, c_custkey % 3 <> 0 AS stale FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def stale_caches(t):
    files = t.orders.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("modified"))
    caches = files.groupBy("name").agg((F.max("modified") - F.when(F.first("name") % 3 == 1, 1).otherwise(0)).alias("newest"), (F.count("*") + F.when(F.first("name") % 3 == 2, 1).otherwise(0)).alias("n_files"))
    return P.stale_caches(caches, files)


@query("""SELECT o_orderkey AS id, true AS sent FROM orders""")
def pushed_pages(t):
    return P.push_pages(t.orders.select(F.col("o_orderkey").alias("id")), lambda ids: len(ids) <= 500)


# quizzes -------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS seed, true AS good FROM customer WHERE c_custkey % 10 = 0""")
def order_questions(t):
    pool = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("chapter"), (1000 + F.col("c_custkey") * 7 % 400).alias("anchor"))
    q = Z.order_questions(pool, pool.where("id % 10 = 0"))
    apart = F.forall("items", lambda a: F.size(F.filter("items", lambda b: F.abs(a["anchor"] - b["anchor"]) < 2)) == 1)
    return q.select("seed", (apart & F.exists("items", lambda x: x["id"] == F.col("seed")) & (F.size("items") == 4)).alias("good"))


@query("""SELECT c_custkey AS id, c_mktsegment AS answer, true AS good FROM customer""")
def choice_questions(t):
    q = Z.choice_questions(t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment")
    return q.select("id", "answer", (F.array_contains("choices", F.col("answer")) & (F.size(F.array_distinct("choices")) == 4)).alias("good"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 8 <= 3 WHEN 1 THEN abs(o_custkey % 200) * 1000000 <= 91400000 ELSE false END AS ok, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 8 WHEN 1 THEN -(o_custkey % 200) * 1000000 END::BIGINT AS delta FROM orders""")
def graded_years(t):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    want = F.when(k == 1, F.lit(-4_570_000_000)).otherwise(F.year("o_orderdate").cast("long"))
    typed = F.when(k == 0, (F.year("o_orderdate") + c % 8).cast("string")).when(k == 1, (F.lit(4_570_000_000) + c % 200 * 1_000_000).cast("string")).otherwise("no idea")
    return t.orders.select(F.col("o_orderkey").alias("id"), Z.grade_year(typed, want).alias("g")).select("id", "g.ok", "g.delta")


@query("""SELECT o_orderkey AS id, o_custkey % 8 <= 3 AND o_orderkey % 2 = 0 AS ok FROM orders""")
def graded_spans(t):
    y = F.year("o_orderdate").cast("long")
    typed = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("-", y.cast("string"), (y + 5 + F.col("o_custkey") % 8).cast("string"))).otherwise(y.cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("id"), Z.grade_span(typed, y, y + 5).alias("g")).select("id", "g.ok")


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS stage FROM customer), r AS (SELECT stage, row_number() OVER (ORDER BY stage) AS r FROM s) SELECT stage, count(*) AS n FROM r WHERE r <= 12 GROUP BY stage""")
def session_stages(t):
    k = F.col("c_custkey")
    items = t.customer.select(k.alias("id"), (k % 3 == 0).alias("opened"), F.when(k % 40 == 0, 5).alias("due"), F.when(k % 2 == 0, 0).alias("last"), F.lit(1).alias("wrong"))
    return Z.session_items(items, 10).groupBy("stage").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 5.0 WHEN 2 THEN 4.0 WHEN 3 THEN 0.6 ELSE 0.25 END::DOUBLE AS weight FROM customer""")
def ask_weights(t):
    k = F.col("c_custkey") % 5
    return t.customer.select(F.col("c_custkey").alias("id"), Z.ask_weight(F.when(k == 1, 0).when(k > 1, 1), F.when(k == 2, 1).otherwise(99), F.when(k == 3, 2).otherwise(0), 10).alias("weight"))


@query("""SELECT 100::BIGINT AS n, true AS known""")
def weighted_sample(t):
    from almanack.operators.ranking import weighted_sample as draw

    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("w"))
    return draw(rows, "id", "w", 100).join(rows.select("id"), "id").agg(F.count("*").alias("n"), (F.count_distinct("id") == 100).alias("known"))


# quality -------------------------------------------------------------------------------------------------


@query(f"""WITH {ENTRIES}, e AS (SELECT *, start + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS ts FROM entries) SELECT 'has a start' AS rule, 0 AS violations UNION ALL SELECT 'runs forwards', count(*) FILTER ("end" < start) FROM e UNION ALL SELECT 'is not after the present', count(*) FILTER (greatest(start, coalesce("end", start)) > 2000) FROM e
UNION ALL SELECT 'text gives the start', count(*) FILTER (ts <> start) FROM e UNION ALL SELECT 'text gives the end of a span', 0 UNION ALL SELECT 'has an origin', count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AND topic <> '5-LOW') FROM e UNION ALL SELECT 'kind is point or span', 0 UNION ALL SELECT 'point has one year', 0 UNION ALL SELECT 'id has three parts', count(*) FROM e""")
def entry_rules(t):
    e = t.entries.withColumns({
        "text_start": F.col("start") + F.when(F.col("id") % 50 == 0, 1).otherwise(0), "text_end": F.col("end"), "wiki": F.when(F.col("id") % 3 == 0, "w"), "qid": F.when(F.col("id") % 5 == 0, "q"),
        "manual": F.col("id") % 7 == 0, "known_dataset": F.col("topic") == "5-LOW",
    })
    return Q.broken(Q.entry_rules(e, 2000))


@query("""WITH p AS (SELECT c_custkey AS k, c_nationkey AS leaf FROM customer)
SELECT rule, violations::BIGINT AS violations FROM (SELECT 'y in range' AS rule, count(*) FILTER (k % 11 = 0) AS violations FROM p UNION ALL SELECT 'fame in range', count(*) FILTER (k % 13 = 0) FROM p UNION ALL SELECT 'point is on a leaf', count(*) FILTER (k % 17 = 0) FROM p
UNION ALL SELECT 'point is in its band', count(*) FILTER (CASE WHEN k % 17 = 0 THEN k % 11 = 0 ELSE k % 11 = 0 OR k % 19 = 0 END) FROM p UNION ALL SELECT 'point is in its node''s years', count(*) FILTER (k % 23 = 0) FROM p UNION ALL SELECT 'no self among neighbours', count(*) FILTER (k % 29 = 0) FROM p
UNION ALL SELECT 'no neighbour twice', count(*) FILTER (k % 31 = 0) FROM p UNION ALL SELECT 'bands lie in their parents', 0 UNION ALL SELECT 'years lie in their parents', count(*) FROM nation WHERE n_nationkey % 5 = 4 UNION ALL SELECT 'siblings do not overlap', 0 UNION ALL SELECT 'leaves leave no gap', 0)""")
def point_rules(t):
    """Customers on the leaves of a tree of nations, some of them in each way where they don't belong."""
    n = F.col("n_nationkey")
    leaves = t.nation.select(n.alias("node"), F.lit(-1).alias("parent"), F.lit(True).alias("is_leaf"), (n / 25).alias("y0"), ((n + 1) / 25).alias("y1"), F.lit(100).alias("x0"), F.when(n % 5 == 4, 950).otherwise(900).alias("x1"), F.lit(1).alias("n"))
    bands = leaves.unionByName(t.region.limit(1).selectExpr("-1 AS node", "CAST(NULL AS INT) AS parent", "false AS is_leaf", "0D AS y0", "1D AS y1", "100 AS x0", "900 AS x1", "25 AS n"))
    k = F.col("c_custkey")
    leaf = F.when(k % 17 == 0, -1).otherwise(F.col("c_nationkey"))
    inside = F.when(k % 17 == 0, 0.5).otherwise((F.col("c_nationkey") + F.when(k % 19 == 0, F.when(F.col("c_nationkey") == 24, -1.5).otherwise(1.5)).otherwise(0.5)) / 25)
    points = t.customer.select(
        k.alias("id"), leaf.alias("leaf"), F.when(k % 23 == 0, 50).otherwise(200).alias("x0"), F.lit(300).alias("x1"), F.when(k % 11 == 0, 1.5).otherwise(inside).alias("y"), F.when(k % 13 == 0, 1.2).otherwise(0.4).alias("fame"),
        F.array(F.when(k % 29 == 0, k).otherwise(k + 1), F.when(k % 31 == 0, F.when(k % 29 == 0, k).otherwise(k + 1)).otherwise(k + 2)).alias("neighbours"),
    )
    return Q.broken(Q.point_rules(points, bands))


@query("""SELECT c_nationkey AS node, (count(*) + CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n, count(*) AS c FROM customer GROUP BY c_nationkey HAVING c_nationkey % 5 = 0""")
def member_counts(t):
    points = t.customer.select(F.col("c_nationkey").alias("leaf"))
    nodes = points.groupBy(F.col("leaf").alias("node")).agg((F.count("*") + F.when(F.first("leaf") % 5 == 0, 1).otherwise(0)).alias("n"))
    return Q.member_counts(points, nodes.select(F.col("node").alias("leaf"), "node"), nodes)


@query("""SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def repeated_keys(t):
    return Q.repeated(t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def missing_vectors(t):
    return Q.missing(t.documents.select("doc_id"), t.embeddings, "doc_id", "vec_id")


@query("""WITH o AS (SELECT label AS g, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY 0 ORDER BY label, vec_id) AS p FROM embeddings) SELECT round(avg(list_dot_product(v, p)), 6) AS adjacent, true AS compared FROM o WHERE p IS NOT NULL""")
def order_means_likeness(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").alias("vector"), F.lit(0).alias("group"))
    return Q.order_means_likeness(rows).select(F.round("adjacent", 6).alias("adjacent"), (F.abs("apart") <= 1).alias("compared"))


@query("""SELECT round(avg(CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS share, avg(CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) < 0.12 AS ok FROM customer""")
def moved_by_placement(t):
    k = F.col("c_custkey")
    return Q.moved_by_placement(t.customer.select(k.alias("id"), (k % 7).alias("node")), t.customer.select(k.alias("id"), F.when(k % 10 == 0, -1).otherwise(k % 7).alias("node"))).select(F.round("share", 6).alias("share"), "ok")


@query("""SELECT * FROM (VALUES ('generic', 'Physics'), ('no-context', 'Physics'), ('dup-intro', 'Battle'), ('far-date', 'Battle'), ('boilerplate', 'Kings'), ('thin-chapter', 'Kings'), ('thin-topic', '2'), ('no-points', '1')) v(kind, about)""")
def topic_findings(t):
    topics = t.spark.createDataFrame([("rome", "About Rome.", True)], "topic string, intro string, chronological boolean")
    chapters = t.spark.createDataFrame([("rome", 0, "Wars", "The wars of Rome were long.", 100, 200, ["a"]), ("rome", 1, "Kings", "Welcome to this page.", 200, 300, [])], "topic string, chapter int, title string, intro string, from int, to int, points array<string>")
    items = t.spark.createDataFrame(
        [("rome", 1, "Battle", "event", 0, True, False, "The wars of Rome were long.", None, False, "link", True, 900), ("rome", 2, "Physics", "concept", 0, True, False, None, None, False, "link", False, 150), ("rome", 3, "King", "person", 1, False, False, "x", None, False, "link", True, 250)],
        "topic string, id int, title string, type string, chapter int, is_key boolean, key_idea boolean, context string, note string, in_intro boolean, via string, on_timeline boolean, start int",
    )
    return Q.topic_findings(topics, chapters, items).select("kind", "about")


# drawing -------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey % 60 AS page, c_custkey AS id, c_custkey * 37 % 400 AS a, c_custkey * 37 % 400 + 30 + c_custkey % 50 AS b, 1 + c_custkey % 2 AS h, c_acctbal AS i FROM customer),
g AS (SELECT page, list([struct_pack(id := id, a := a, b := b, r := NULL::BIGINT, h := h)] ORDER BY i DESC, id) AS xs FROM c GROUP BY page),
f AS (SELECT page, list_reduce(xs, lambda acc, x: list_append(acc, struct_pack(id := x[1].id, a := x[1].a, b := x[1].b, r := list_filter(range(0, 2000), lambda r: len(list_filter(acc, lambda o: o.a < x[1].b AND o.b > x[1].a AND o.r < r + x[1].h AND o.r + o.h > r)) = 0)[1], h := x[1].h)), []::STRUCT(id BIGINT, a BIGINT, b BIGINT, r BIGINT, h BIGINT)[]) AS got FROM g)
SELECT page, u.id AS id, u.r::INT AS "row" FROM (SELECT page, unnest(got) AS u FROM f)""")
def packed_cards(t):
    """All customers as cards of one or two rows on sixty pages, the richest first."""
    k = F.col("c_custkey")
    left = (k * 37 % 400).cast("double")
    cards = t.customer.select((k % 60).alias("page"), k.alias("id"), left.alias("left"), (left + 30 + k % 50).alias("right"), (1 + k % 2).cast("int").alias("height"), F.col("c_acctbal").alias("importance"))
    return L.packed_cards(cards, "page")


@query("""WITH s AS (SELECT p_partkey AS id, p_size % 5 AS g, 10 + p_partkey % 3 * 30 AS a, 30 + p_partkey % 3 * 30 AS b, p_retailprice AS i FROM part) SELECT g, id, row_number() OVER (PARTITION BY g, a ORDER BY i DESC, id)::INT - 1 AS "row" FROM s QUALIFY "row" < 3""")
def packed_bars(t):
    k = F.col("p_partkey")
    spans = t.part.select(k.alias("id"), (F.col("p_size") % 5).alias("g"), (10 + k % 3 * 30).alias("a"), (30 + k % 3 * 30).alias("b"), F.lit(False).alias("is_key"), F.col("p_retailprice").alias("importance"))
    vast = t.spark.createDataFrame([(-1, 0, -900, 900, True, 9e9)], "id long, g int, a long, b long, is_key boolean, importance double")
    return L.pack_bars(spans.select("id", "g", "a", "b", "is_key", "importance").unionByName(vast), "g", "a", "b", (0, 100)).select("g", "id", "row")


@query("""WITH s AS (SELECT p_partkey AS id, p_size % 5 AS lane, p_partkey % 4 AS slot, p_retailprice AS i FROM part) SELECT lane, id, row_number() OVER (PARTITION BY lane, slot ORDER BY i DESC, id)::INT - 1 AS "row" FROM s QUALIFY "row" < 2""")
def lane_rows(t):
    k = F.col("p_partkey")
    marks = t.part.select((F.col("p_size") % 5).alias("lane"), F.lit("events").alias("kind"), k.alias("id"), (k % 4 * 40.0).alias("left"), (k % 4 * 40.0 + 30).alias("right"), F.col("p_retailprice").alias("priority"))
    return L.lane_rows(marks, {"events": 2}).select("lane", "id", "row")


@query("""WITH l AS (SELECT p_size AS section, p_partkey AS seq, p_partkey % 4 AS r, p_size = 2 AS folded, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 AS f FROM part), h AS (SELECT *, CASE WHEN folded THEN 0 ELSE 14 + 18 * r + 6 END AS h, CASE WHEN f THEN 22 ELSE 0 END AS s FROM l)
SELECT seq, (sum(h + s) OVER (ORDER BY section, seq) - h)::DOUBLE AS y FROM h""")
def stacked_lanes(t):
    k = F.col("p_partkey")
    return L.stack_lanes(t.part.select(F.col("p_size").alias("section"), k.alias("seq"), (k % 4).alias("rows"), (F.col("p_size") == 2).alias("folded"))).select("seq", "y")


@query(f"""WITH {ENTRIES} SELECT id FROM entries WHERE start <= 1998.5 AND coalesce("end", start) >= 1997.5 AND (id % 100) / 100.0 BETWEEN 0.25 AND 0.5""")
def grid_index(t):
    rows = t.entries.select("id", "start", F.coalesce("end", "start").alias("end"), ((F.col("id") % 100) / 100).alias("y"))
    return L.grid_query(L.grid_cells(rows, 1990, 2010), 1990, 2010, (1997.5, 1998.5, 0.25, 0.5))


@query("""WITH g AS (SELECT p_type, p_size - lag(p_size) OVER (PARTITION BY p_type ORDER BY p_size) AS g FROM part), l AS (SELECT p_type, list_sort(list(g)) AS gs FROM g WHERE g > 0 GROUP BY p_type) SELECT p_type, round(180.0 / gs[floor(0.4 * (len(gs) - 1))::INT + 1], 6)::DOUBLE AS px FROM l""")
def default_zooms(t):
    return L.default_zoom(t.part, "p_type", "p_size").select("p_type", F.round("px", 6).alias("px"))


@query(f"""WITH {ENTRIES} SELECT id, CASE WHEN id % 2 = 0 AND "end" > start AND NOT open_ended THEN 'eras' WHEN id % 5 = 0 AND "end" > start THEN 'reigns' ELSE 'cards' END AS track FROM entries""")
def span_tracks(t):
    e = t.entries
    return e.select("id", L.track_of(F.when(F.col("id") % 2 == 0, "period").otherwise("person"), F.col("start"), F.col("end"), F.col("open_ended"), F.when(F.col("id") % 5 == 0, "leaders")).alias("track"))


@query("""SELECT p_partkey AS id, (p_partkey % 101 / 100.0)::DOUBLE AS back, p_partkey % 101 / 100.0 BETWEEN 0.25 AND 0.75 AS squeezed FROM part""")
def warped_axis(t):
    y = F.col("p_partkey") % 101 / 100
    down = L.warp(y, [(0.25, 0.5), (0.5, 0.75)], 900.0)
    rows = t.part.select(F.col("p_partkey").alias("id"), y.alias("y"), down.alias("w"))
    near = F.abs(F.col("w") - 0.5) <= 0.0201
    return rows.select("id", F.round(L.warp(F.col("w"), [(0.25, 0.5), (0.5, 0.75)], 900.0, inverse=True), 6).alias("back"), near.alias("squeezed"))


@query(f"""WITH {ENTRIES}, r AS (SELECT grp, CASE WHEN person AND "end" IS NOT NULL THEN floor(start + ("end" - start) * 0.6 + 0.5) ELSE start END AS a FROM entries) SELECT grp, list_sort(list(a))[floor(count(*) * 0.01)::INT + 1]::BIGINT AS lo, list_sort(list(a))[count(*) - floor(count(*) * 0.01)::INT]::BIGINT AS hi FROM r GROUP BY grp""")
def dense_extents(t):
    from almanack.functions.dates import anchor_year
    from almanack.operators.ranking import at_ranks

    rows = t.entries.select("grp", anchor_year(F.col("start"), F.col("end"), F.col("person")).alias("a"))
    k = F.floor(F.col("n") * 0.01)
    return at_ranks(rows, "grp", "a", lo=k, hi=F.col("n") - 1 - k).drop("n")


@query("""WITH n AS (SELECT l_suppkey AS seed, l_partkey AS t FROM lineitem), f AS (SELECT t, count(*) AS n FROM n WHERE t % 5 <> 0 GROUP BY t) SELECT t AS title, n FROM f QUALIFY row_number() OVER (ORDER BY n DESC, t) <= 40""")
def suggested_neighbours(t):
    from almanack.operators.search import suggest

    near = t.lineitem.select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("title"))
    return suggest(near, t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("title")), 20)


@query(f"""WITH {ENTRIES} SELECT topic AS subject, count(*) AS n FROM entries WHERE kind = 'span' AND id % 2 = 0 GROUP BY topic""")
def shown_subject_counts(t):
    from almanack.operators.entries import visible

    rows = t.entries.withColumns({"on_timeline": F.col("kind") == "span", "is_key": F.col("id") % 2 == 0, "subject": F.col("topic")})
    return rows.where(visible(False, [], [])).groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject")


@query("""SELECT p_type AS leaf, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)::INT - 1 AS rank FROM part""")
def rank_in_leaf(t):
    r = F.row_number().over(Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")) - 1
    return t.part.select(F.col("p_type").alias("leaf"), F.col("p_partkey").alias("id"), r.alias("rank"))


@query("""WITH c AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS a FROM orders GROUP BY o_custkey) SELECT id, len(list_distinct(list_concat(a, ['1-URGENT', 'new'])))::INT AS n, len(list_intersect(a, ['1-URGENT', 'new']))::INT AS shared FROM c""")
def topic_unions(t):
    c = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("a"))
    other = F.array(F.lit("1-URGENT"), F.lit("new"))
    return c.select("id", F.size(F.array_union("a", other)).alias("n"), F.size(F.array_intersect("a", other)).alias("shared"))


@query(f"""WITH {ENTRIES} SELECT id, CASE WHEN start < -500 THEN 'Iron Age' WHEN start < 1800 THEN 'Early modern' WHEN start < 1945 THEN 'Modern' ELSE 'Contemporary' END AS era FROM entries""")
def era_names(t):
    return t.entries.select("id", W.era_name(F.col("start"), "civ").alias("era"))
