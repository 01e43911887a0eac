"""Queries of dated events mined from pages and prose, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.operators import events as M
from almanack.plans.catalog import query

# Chronicles: a page for each customer, whose lines tell the orders in one of nine ways. The SQL says from the
# orders what the miner has to find in the text; it parses nothing.
_NAMED = "'order ' || o_orderkey || ' of priority ' || o_orderpriority"
_FORMS = {
    0: "year(o_orderdate) || ' – order ' || o_orderkey || ' of priority ' || o_orderpriority",
    1: "'The clerk filed it. In ' || year(o_orderdate) || ' order ' || o_orderkey || ' of priority ' || o_orderpriority || ' was placed at last.'",
    2: "'== ' || year(o_orderdate) || ' ==\n' || 'order ' || o_orderkey || ' of priority ' || o_orderpriority || '\n== Later ==\nno year [12] here (  ) at all'",
    3: "'== The first millennium BC ==\n' || (100 + o_custkey % 800) || ' – order ' || o_orderkey || ' of priority ' || o_orderpriority || '\n== Later ==' ",
    4: "'== References ==\n' || year(o_orderdate) || ' – order ' || o_orderkey || ' of priority ' || o_orderpriority || '\n== Later ==' ",
    5: "year(o_orderdate) || ' – the end of the year\n' || year(o_orderdate) || ' – The end of the year\n' || year(o_orderdate) || ' – brief'",
    6: "'== The first millennium BC ==\n' || (100 + o_custkey % 800) || '–' || (110 + o_custkey % 800) || ' – order ' || o_orderkey || ' told backwards\n== Later =='",
    7: "'2.070 Ma – order ' || o_orderkey || ' of an unclear age'",
    8: "year(o_orderdate) || '–' || (year(o_orderdate) + 3) || ': order ' || o_orderkey || ' of priority ' || o_orderpriority || ': it was large'",
}


def chronicles(t):
    """(page, title, body) of every customer with orders, lines in the order of their keys."""
    said = F.expr("CASE " + " ".join(f"WHEN o_orderkey % 9 = {k} THEN {e}" for k, e in _FORMS.items()) + " END")
    lines = t.orders.select(F.col("o_custkey").alias("page"), "o_orderkey", said.alias("line"))
    told = lines.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("l"))
    return told.select("page", F.concat(F.lit("Chronicle of customer "), F.col("page").cast("string")).alias("title"), F.concat(F.lit("== Orders ==\n"), F.array_join("l.line", "\n")).alias("body"))


_TOLD = """o AS (SELECT o_custkey AS page, o_orderkey AS k, o_orderkey % 9 AS f, year(o_orderdate)::BIGINT AS y, o_custkey AS c, 'rder ' || o_orderkey || ' of priority ' || o_orderpriority AS what FROM orders),
e AS (SELECT *, CASE WHEN f = 1 THEN 'mined-prose' ELSE 'mined-line' END AS tier, CASE f WHEN 3 THEN -(100 + c % 800) ELSE y END AS start, CASE f WHEN 3 THEN -(100 + c % 800) WHEN 8 THEN y + 3 ELSE y END AS "end",
CASE f WHEN 3 THEN (100 + c % 800) || ' BC' WHEN 8 THEN y || '–' || (y + 3) ELSE y::VARCHAR END AS year_text,
CASE f WHEN 1 THEN 'In ' || y || ' o' || what || ' was placed at last' WHEN 5 THEN 'The end of the year' ELSE 'O' || what END AS name,
CASE f WHEN 1 THEN 'In ' || y || ' o' || what || ' was placed at last.' WHEN 3 THEN (100 + c % 800) || ' – o' || what WHEN 5 THEN y || ' – the end of the year' WHEN 8 THEN y || '–' || (y + 3) || ': o' || what || ': it was large' ELSE y || ' – o' || what END AS excerpt
FROM o WHERE f NOT IN (4, 6, 7)),
d AS (SELECT *, row_number() OVER (PARTITION BY page, start, lower(name) ORDER BY k) AS r FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY page, tier ORDER BY k) AS n FROM d WHERE r = 1)"""


@query(f"""WITH {_TOLD} SELECT page, tier, start, "end", year_text, CASE WHEN start <> "end" THEN 'span' ELSE 'point' END AS kind, name, excerpt FROM b WHERE n <= 6""")
def chronicle_events(t):
    events, _ = M.mine_events(chronicles(t), limit=6)
    return events.select("page", "tier", "start", "end", "year_text", "kind", "name", "excerpt")


@query(f"""WITH {_TOLD}, a AS (SELECT *, row_number() OVER (PARTITION BY start, lower(name) ORDER BY CASE tier WHEN 'mined-line' THEN 1 ELSE 2 END, page) AS one FROM b) SELECT page, tier, start, name FROM a WHERE one = 1""")
def chronicle_events_once(t):
    events, _ = M.mine_events(chronicles(t))
    return M.told_once(events).select("page", "tier", "start", "name")


@query("""SELECT o_custkey AS page, 'Order ' || o_orderkey || CASE o_orderkey % 9 WHEN 6 THEN ' told backwards' ELSE ' of an unclear age' END AS name,
CASE o_orderkey % 9 WHEN 6 THEN (100 + o_custkey % 800) || '–' || (110 + o_custkey % 800) || ' BC' ELSE '2.070 Ma' END AS year_text, CASE o_orderkey % 9 WHEN 6 THEN 'backwards span' ELSE 'ambiguous separator' END AS reason FROM orders WHERE o_orderkey % 9 IN (6, 7)""")
def refused_events(t):
    _, refused = M.mine_events(chronicles(t))
    return refused.select("page", "name", "year_text", "reason")


@query()
def mined_events(t):
    """Of every whole page, document and chronicle, each event once."""
    pages = t.pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("page"), F.col("url").alias("title"), M.page_body(F.col("html")).alias("body"), "html")
    texts = t.documents.select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("page"), F.lit("").alias("title"), F.col("text").alias("body"))
    told = chronicles(t).withColumn("page", F.concat(F.lit("customer "), F.col("page").cast("string")))
    events, _ = M.mine_events(pages.drop("html").unionByName(texts).unionByName(told), tables=M.table_rows(pages))
    return M.told_once(events)


# Results: a page for each of 120 groups of customers, a table in one of six shapes with two rows an order that share its year.
_RECIPES = [
    ("Cup 0", "the cup", None, None, None, None, None, None, None, None, None, None), ("Cup 1", "the league", "(?i)^champions", None, None, None, None, None, None, None, None, True),
    ("Cup 2", "the finals", None, None, None, None, ["(?i)^western champion", "(?i)^eastern champion"], None, None, None, None, None),
    ("Cup 3", None, None, None, None, None, None, [("(?i)^alpha open$", "the Alpha Open"), ("(?i)^beta open", "the Beta Open")], True, None, None, None),
    ("Cup 4", "the title", "(?i)^driver$", None, "(?i)^constructor$", "driving for", None, None, True, None, None, None), ("Cup 5", "Bowl {game}", None, "(?i)^game$", None, None, None, None, None, None, True, None),
]
_HEADS = ["<th>Year</th><th>Winners</th><th>Score</th><th>Runners-up</th>", "<th>Season</th><th>Champions (titles)</th><th>Runners-up</th>", "<th>x</th><th>Western champion</th><th>Result</th><th>Eastern champion</th>",
    "<th>Year</th><th>Alpha Open</th><th>Beta Open</th>", "<th>Season</th><th>Driver</th><th>Constructor</th>", "<th>Date</th><th>Game</th><th>Winning team</th><th>Score</th><th>Losing team</th><th>Score</th>"]


@query("""WITH o AS (SELECT o_custkey % 120 AS page, o_custkey % 6 AS f, o_orderkey AS k, year(o_orderdate)::BIGINT AS y, o_orderkey % 5 = 0 AS void FROM orders),
r AS (SELECT *, unnest([1, 2]) AS h FROM o), t AS (SELECT *, 'Team ' || k || '-' || h AS w, 'Side ' || k AS l FROM r),
e AS (SELECT page, y, w || ' win the cup' AS title, y || ' – ' || w || ' win the cup, beating ' || l || ' 3–' || h || '.' AS sentence FROM t WHERE f = 0 AND NOT (void AND h = 2)
UNION ALL SELECT page, y + 1, w || ' win the league', (y + 1) || ' – ' || w || ' win the league.' FROM t WHERE f = 1
UNION ALL SELECT page, y, CASE h WHEN 1 THEN w ELSE l END || ' win the finals', y || ' – ' || CASE h WHEN 1 THEN w || ' win the finals, beating ' || l || ' 4–1' ELSE l || ' win the finals, beating ' || w || ' 1–4' END || '.' FROM t WHERE f = 2
UNION ALL SELECT page, y, w || ' wins the Alpha Open', y || ' – ' || w || ' wins the Alpha Open.' FROM t WHERE f = 3 UNION ALL SELECT page, y, l || ' wins the Beta Open', y || ' – ' || l || ' wins the Beta Open.' FROM t WHERE f = 3 AND NOT void
UNION ALL SELECT page, y, w || ' wins the title', y || ' – ' || w || ' wins the title, driving for ' || l || '.' FROM t WHERE f = 4
UNION ALL SELECT page, y, w || ' win Bowl ' || k || h, y || ' – ' || w || ' win Bowl ' || k || h || ', beating ' || l || ' 20–' || h || '.' FROM t WHERE f = 5)
SELECT page, y AS year, title, min(sentence) AS sentence FROM e GROUP BY ALL""")
def recipe_results(t):
    """Tables of all orders in six shapes, with years over two rows, seasons, tallies, notes, bold winners and rows that weren't held."""
    from almanack.operators import results as R

    k, f, y, void = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 6, F.year("o_orderdate"), F.col("o_orderkey") % 5 == 0
    td = lambda *xs: F.concat(F.lit("<td>"), *[x if not isinstance(x, str) else F.lit(x) for x in xs], F.lit("</td>"))
    season = F.concat(y.cast("string"), F.lit("–"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    when = F.concat(F.lit("<td rowspan=2>"), F.when(f == 1, season).otherwise(y.cast("string")), F.lit("<sup>[1]</sup></td>"))

    def row(h):
        w, l, n = F.concat(F.lit("Team "), k, F.lit(f"-{h}")), F.concat(F.lit("Side "), k), str(h)
        west, east = (td("<b>", w, "</b>"), td(l)) if h == 1 else (td(w), td("<b>", l, "</b>"))
        shapes = [
            F.concat(td(F.when(void & F.lit(h == 2), F.lit("Not held")).otherwise(w), " (2)"), td("3–" + n), td(l, "†")), F.concat(td(w, " (1, 3–2) [note]"), td(l)), F.concat(west, td("4–1"), east),
            F.concat(td(w), td(F.when(void, F.lit("—")).otherwise(l))), F.concat(td(w, " *"), td(l)), F.concat(td(k, n), td(w), td("20"), td(l), td(n)),
        ]
        return F.concat(F.lit("<tr>"), when if h == 1 else F.lit(""), F.element_at(F.array(*shapes), (f + 1).cast("int")), F.lit("</tr>"))

    # a page in parts, in order: its opening, the rows of each order, its end
    part = lambda n, k: F.struct(F.lit(n).alias("n"), k.cast("long").alias("k")).alias("part")
    told = t.orders.select((F.col("o_custkey") % 120).alias("page"), f.alias("f"), part(1, F.col("o_orderkey")), F.concat(row(1), row(2)).alias("html"))
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("f") + 1).cast("int"))
    opening = F.concat(F.lit("<table><tr><th>Year</th><th>Winners</th></tr></table><table class='wikitable'><tr>"), head, F.lit("</tr>"))
    ends = F.array(F.struct(part(0, F.lit(None)), opening.alias("html")), F.struct(part(2, F.lit(None)), F.lit("</table>").alias("html")))
    parts = told.unionByName(told.select("page", "f").distinct().select("page", "f", F.inline(ends)))
    pages = parts.select("page", F.concat(F.lit("Cup "), F.col("f").cast("string")).alias("title"), "part", "html")
    return R.mine_results(pages, t.spark.createDataFrame(_RECIPES, R.RECIPE), 2026)
