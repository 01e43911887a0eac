"""Queries of bins, axes with breaks, lanes by zoom and seeded draws, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.functions import strings as S
from almanack.operators import entries as E, layout as L, ranking as K
from almanack.plans.catalog import ENTRIES, query
from almanack.sources import store as T

# bins -----------------------------------------------------------------------------------------------

_NEXT_FIT = """f AS (SELECT list_reduce(list(list_value(struct_pack(bin := 0, held := c)) ORDER BY leaf, part), lambda acc, x: list_append(acc, CASE WHEN acc[-1].held + x[1].held > {size}
THEN struct_pack(bin := acc[-1].bin + 1, held := x[1].held) ELSE struct_pack(bin := acc[-1].bin, held := acc[-1].held + x[1].held) END)) AS b, list(leaf ORDER BY leaf, part) AS ls, list(part ORDER BY leaf, part) AS ps FROM p),
g AS (SELECT unnest(ls) AS leaf, unnest(ps) AS part, unnest(list_transform(b, lambda x: x.bin))::BIGINT AS file FROM f)"""


@query(f"""WITH r AS (SELECT p_partkey AS id, p_type AS leaf, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS r FROM part), p AS (SELECT leaf, r // 30 AS part, count(*)::INT AS c FROM r GROUP BY ALL), {_NEXT_FIT.format(size=100)}
SELECT id, r.leaf, g.part, file FROM r JOIN g ON g.leaf = r.leaf AND g.part = r.r // 30""")
def detail_groups(t):
    return T.detail_groups(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("leaf"), F.col("p_partkey").alias("seq")), 30, 100)


@query(f"""WITH p AS (SELECT o_orderkey AS leaf, 0 AS part, (1 + o_custkey % 40 + CASE WHEN o_orderkey % 97 = 0 THEN 500 ELSE 0 END)::INT AS c FROM orders WHERE o_custkey IS NOT NULL), {_NEXT_FIT.format(size=200)} SELECT leaf AS id, file AS bin FROM g""")
def next_fit_bins(t):
    """All orders in turn into bins of 200, some of them larger than a bin."""
    size = (1 + F.col("o_custkey") % 40 + F.when(F.col("o_orderkey") % 97 == 0, 500).otherwise(0)).cast("long")
    return T.next_fit(t.orders.select(F.col("o_orderkey").alias("id"), size.alias("size")), 200, F.asc("id")).select("id", "bin")


# axes ------------------------------------------------------------------------------------------------

_YEARS = """y AS (SELECT o_orderkey AS id, o_custkey % 40 AS topic, CASE o_orderkey % 6 WHEN 0 THEN -300 + o_custkey % 23 WHEN 1 THEN 1480 + o_custkey % 31 ELSE year(o_orderdate) END::DOUBLE AS year FROM orders),
d AS (SELECT DISTINCT topic, year FROM y), n AS (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY topic ORDER BY year) > 688.0 / 12 THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY topic ORDER BY year) AS s FROM n), r AS (SELECT topic, s, min(year) AS y0, max(year) AS y1 FROM s GROUP BY ALL),
g AS (SELECT *, 184 + coalesce(sum((y1 - y0) * 12 + 234) OVER (PARTITION BY topic ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS px0 FROM r)"""


def _years(t):
    year = F.when(F.col("o_orderkey") % 6 == 0, -300 + F.col("o_custkey") % 23).when(F.col("o_orderkey") % 6 == 1, 1480 + F.col("o_custkey") % 31).otherwise(F.year("o_orderdate"))
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("topic"), year.cast("double").alias("year"))


@query(f"""WITH {_YEARS}, e AS (SELECT topic, round(184 + (-1500 - min(y0)) * 12, 6) AS early FROM g GROUP BY topic) SELECT id, y.topic, round(px0 + (year - y0) * 12, 6) AS x, year AS back, early, true AS cut FROM y JOIN g ON g.topic = y.topic AND year BETWEEN y0 AND y1 JOIN e ON e.topic = y.topic""")
def broken_axis(t):
    """The pixel of every order's year on its topic's axis, the year read back from it, and the pixel of a year before all."""
    rows = _years(t)
    axes = L.axis_segments(rows, "topic", "year", 12.0)
    on = rows.join(axes, "topic").withColumn("x", L.axis_x(F.col("segments"), F.col("year"), 12.0))
    early, gap = L.axis_x(F.col("segments"), F.lit(-1500.0), 12.0), L.axis_year(F.col("segments"), F.element_at("segments", 1)["px1"] + L.PAD, 12.0)
    return on.select("id", "topic", F.round("x", 6).alias("x"), F.round(L.axis_year(F.col("segments"), F.col("x"), 12.0), 6).alias("back"), F.round(early, 6).alias("early"), (gap == F.element_at("segments", 1)["y1"]).alias("cut"))


@query(f"""WITH {_YEARS}, k AS (SELECT topic, y0, y1, px0, unnest(CASE WHEN floor(least(y1 + 5, y1 + 1) / 10) >= ceil(y0 / 10) THEN range(ceil(y0 / 10)::INT, floor(least(y1 + 5, y1 + 1) / 10)::INT + 1) ELSE [NULL] END) AS k FROM g)
SELECT topic, coalesce(k * 10, y0)::DOUBLE AS year, round(px0 + (coalesce(k * 10, y0) - y0) * 12, 6) AS x, k IS NULL AS edge FROM k""")
def axis_stops(t):
    axes = L.axis_segments(_years(t), "topic", "year", 12.0)
    return L.axis_stops(axes, "topic", 10.0, 12.0).select("topic", F.col("year").cast("double").alias("year"), F.round("x", 6).alias("x"), "edge")


# lanes -----------------------------------------------------------------------------------------------


def _lanes_sql() -> str:
    """Zoom by zoom: each tile's marks folded one by one, those of the parent tile first."""
    parts = ["""m AS (SELECT o_orderkey AS id, o_custkey % 6 AS lane, CASE o_orderkey % 4 WHEN 0 THEN 'spans' WHEN 1 THEN 'people' ELSE 'events' END AS kind, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS s,
CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 300 WHEN o_orderkey % 4 = 1 THEN o_custkey % 90 ELSE 0 END::DOUBLE AS d, (20 + o_orderkey % 5 * 15)::DOUBLE AS label, o_totalprice AS p FROM orders)"""]
    for z in range(3):
        caps = L.lane_caps(z)
        parts.append(f"""a{z} AS (SELECT *, s * {0.2 * 2**z} AS a, (s + d) * {0.2 * 2**z} AS b FROM m),
b{z} AS (SELECT *, CASE WHEN kind = 'spans' THEN a - 3 WHEN b - a >= 8 THEN a - 5 ELSE a - 10 END AS l, CASE WHEN kind = 'spans' THEN greatest(b, a + 6) + 3 WHEN b - a >= 8 THEN greatest(b, a + 2 + label) + 5 ELSE a + 14 + label END AS r FROM a{z}),
t{z} AS (SELECT *, unnest(range(greatest(0, floor(l / 1024))::INT, floor(r / 1024)::INT + 1)) AS tile FROM b{z} WHERE r >= 0),
c{z} AS (SELECT lane, kind, tile, id, p, greatest(0, least(255, floor((l - tile * 1024) / 4)))::INT AS i, greatest(0, least(255, floor((r - tile * 1024) / 4)))::INT AS j, CASE kind WHEN 'spans' THEN {caps['spans']} WHEN 'people' THEN {caps['people']} ELSE {caps['events']} END AS cap FROM t{z}),
""" + (f"k{z} AS (SELECT *, NULL::INT AS row, NULL::INT AS first FROM c{z})," if z == 0 else f"k{z} AS (SELECT c.*, o.row, o.first FROM c{z} c LEFT JOIN o{z - 1} o ON o.lane = c.lane AND o.kind = c.kind AND o.id = c.id AND o.tile = c.tile // 2),") + f"""
g{z} AS (SELECT lane, kind, tile, any_value(cap) AS cap, list([struct_pack(id := id, i := i, j := j, row := row, first := first)] ORDER BY row IS NULL, p DESC, id) AS xs FROM k{z} GROUP BY lane, kind, tile),
f{z} AS (SELECT lane, kind, tile, list_reduce(xs, lambda acc, x: CASE WHEN x[1].row IS NOT NULL THEN list_append(acc, x[1]) ELSE
list_concat(acc, list_transform(list_filter(range(cap), lambda r: len(list_filter(acc, lambda o: o.row = r AND o.i <= x[1].j AND o.j >= x[1].i)) = 0)[1:1], lambda r: struct_pack(id := x[1].id, i := x[1].i, j := x[1].j, row := r::INT, first := {z}))) END,
[]::STRUCT(id BIGINT, i INTEGER, j INTEGER, "row" INTEGER, "first" INTEGER)[]) AS got FROM g{z}),
o{z} AS (SELECT lane, kind, tile, u.id AS id, u.row AS row, u.first AS first FROM (SELECT lane, kind, tile, unnest(got) AS u FROM f{z}))""")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {z} AS z, lane, kind, tile, id, row, first FROM o{z}" for z in range(3))


@query(_lanes_sql())
def lanes_by_zoom(t):
    """All orders as marks in six lanes, at three zooms."""
    k = F.col("o_orderkey")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    lasted = F.when(k % 4 == 0, F.col("o_custkey") % 300).when(k % 4 == 1, F.col("o_custkey") % 90).otherwise(0)
    marks = t.orders.select(
        (F.col("o_custkey") % 6).alias("lane"), F.when(k % 4 == 0, "spans").when(k % 4 == 1, "people").otherwise("events").alias("kind"), k.alias("id"),
        start.alias("start"), (start + lasted).alias("end"), (20 + k % 5 * 15).cast("double").alias("label"), F.col("o_totalprice").alias("priority"),
    )
    return L.zoomed_lanes(marks, 0.0, 0.2, 3)


# draws -----------------------------------------------------------------------------------------------

_IMUL = lambda a, b: f"(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::BIGINT"


@query(f"""WITH a AS (SELECT c_custkey AS id, ((c_nationkey + c_custkey * 1831565813::HUGEINT) % 4294967296)::BIGINT AS a FROM customer), t AS (SELECT id, {_IMUL("xor(a, a >> 15)", "a | 1")} AS t FROM a),
u AS (SELECT id, xor(t, (t + {_IMUL("xor(t, t >> 7)", "t | 61")}) % 4294967296) AS t FROM t) SELECT id, xor(t, t >> 14) / 4294967296.0::DOUBLE AS drawn FROM u""")
def seeded_draws(t):
    """The number that the generator seeded with a customer's nation draws in the customer's turn."""
    return t.customer.select(F.col("c_custkey").alias("id"), K.draw(F.col("c_nationkey"), F.col("c_custkey")).alias("drawn"))


_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT, 2166136261::BIGINT)"


@query(f"""SELECT p_partkey AS id, {_FNV.format("p_name || ' ' || p_brand")} AS h FROM part""")
def fnv_hashes(t):
    return t.part.select(F.col("p_partkey").alias("id"), S.fnv1a(F.concat_ws(" ", "p_name", "p_brand")).alias("h"))


@query(f"""WITH {ENTRIES} SELECT id, round(CASE WHEN id % 50 = 0 THEN 400 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN kind = 'span' THEN 20 ELSE 0 END + least(30, length('Entry ' || id) / 2) + 250 * fame / 1e6 + ({_FNV.format("'e-' || id")} % 1000) / 1000, 8) AS priority FROM entries""")
def point_priorities(t):
    """Ties are broken by the hash of the id."""
    rows = t.entries.withColumns({"title": F.concat(F.lit("Entry "), F.col("id").cast("string")), "has_image": F.col("id") % 2 == 0, "fame": F.col("fame") / 1e6})
    return rows.select("id", F.round(E.point_priority(F.col("id") % 50 == 0, S.fnv1a(F.concat(F.lit("e-"), F.col("id").cast("string")))), 8).alias("priority"))
