"""Faults found by the third review, each on the smallest tables that showed it, against the query's SQL."""

import duckdb
import numpy as np

from almanack.operators import events as M, quiz as Z, resolve as R, vectors as V
from almanack.plans import catalog, catalog_links, catalog_store, catalog_text, catalog_trees  # noqa: F401


def agree(spark, folder, name, **tables):
    """Whether a query and its SQL give the same rows over tables, each a SELECT."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = sorted(map(repr, map(tuple, df.select(*columns).collect()))), sorted(map(repr, found.fetchall()))
    assert got == want


def test_home_lanes_with_keys_beyond_a_thousand(spark, tmp_path):
    """of lines that score alike the first number wins, however far apart their suppliers' keys are."""
    lines = "SELECT 1::BIGINT AS l_orderkey, unnest([3, 5001])::BIGINT AS l_suppkey, unnest([1, 2])::INT AS l_linenumber, 'N' AS l_returnflag, 0.1::DOUBLE AS l_discount, 'O' AS l_linestatus"
    agree(spark, tmp_path, "home_lanes", lineitem=lines, supplier="SELECT unnest([3, 5001])::BIGINT AS s_suppkey")


def test_said_years_of_large_keys(spark, tmp_path):
    """F16: years of customers beyond 9,900 are told by their digits alone, as the SQL tells them."""
    agree(spark, tmp_path, "said_years", orders="SELECT i::BIGINT AS o_orderkey, unnest([5, 9899, 9900, 9999, 88000, 99999, 100000, 870123])::BIGINT AS o_custkey FROM range(6) r(i)")


def test_text_detectors_say_why(spark, tmp_path):
    """the detectors' query says again why a text is refused for its style."""
    agree(spark, tmp_path, "text_detectors", orders="SELECT i::BIGINT AS o_orderkey FROM range(10) r(i)")
    assert "reason" in catalog.QUERIES["text_detectors"](spark, str(tmp_path)).columns


def test_ages_that_no_long_holds_are_no_dates(spark, tmp_path):
    """an age of twenty digits in a text is no date; the other dates of the text stay."""
    said = "It began 12345678901234567890 years ago. It was 99999999999 billion years ago. In 1850 it ended."
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS doc_id, '{said}' AS text) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    rows = catalog.QUERIES["found_dates"](spark, str(tmp_path)).collect()
    assert [(r.n, r.first_year) for r in rows] == [(1, 1850)]
    pages = spark.createDataFrame([("p", "", said)], "page string, title string, body string")
    assert [r.start for r in M.page_lines(pages).select(M.dates_in(M.F.col("line"), "loose").alias("d")).select("d.start").collect()] == [None]


def test_roll_up_of_a_chain_and_a_missing_parent(spark):
    """values go up a chain deeper than a few doublings, and from nodes whose parent isn't there; no node's path is kept."""
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(37)] + [(101, 100)], "id long, parent long")
    own = spark.createDataFrame([(i, i, i, 1) for i in range(3, 37, 3)] + [(101, 5, 6, 2)], "id long, lo long, hi long, n long")
    rows = R.roll_up(nodes, own, lo=R.F.min, hi=R.F.max, n=R.F.sum).collect()
    want = {i: (min(x for x in range(3, 37, 3) if x >= i), 36, sum(x >= i for x in range(3, 37, 3))) for i in range(37)} | {101: (5, 6, 2)}
    assert {r.id: (r.lo, r.hi, r.n) for r in rows} == want and len(rows) == len(want)


def test_gaps_read_no_frame_to_the_end(spark, tmp_path):
    """places before and after are both running ones, with equal projections too."""
    agree(spark, tmp_path, "gap_places", part="SELECT i::BIGINT AS p_partkey, 't' || i % 2 AS p_type, (i * 7 % 5)::INT AS p_size FROM range(40) r(i)")
    plan = catalog.QUERIES["gap_places"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower()


def test_copies_of_spans_meet_once(spark, tmp_path):
    """many spans of one title, start and end are one kind when they meet others."""
    agree(spark, tmp_path, "once_told_spans", part="SELECT (i * 50)::BIGINT AS p_partkey, (i % 3 * 9)::INT AS p_size, (i * 13 % 17)::DOUBLE AS p_retailprice FROM range(60) r(i)")
    spans = catalog.QUERIES["once_told_spans"](spark, str(tmp_path))
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("min(struct") + spans._jdf.queryExecution().optimizedPlan().toString().count("min(rank") >= 1


def test_copies_of_titles_meet_once(spark, tmp_path):
    """parts of one name and year are one kind when they meet others."""
    agree(spark, tmp_path, "event_twins", part="SELECT (i * 300 + i % 2 * 1500 + i % 3)::BIGINT AS p_partkey, CASE WHEN i % 3 = 0 THEN 'old plate' ELSE 'hot bolt' END AS p_name FROM range(60) r(i)")
    assert catalog.QUERIES["event_twins"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("min(id") >= 2


def test_order_questions_meet_years(spark):
    """a seed meets each year around its chapter once, whatever the entries of the year; draws are of the pool and no two are near."""
    pool = spark.createDataFrame([(i, i % 3, 1000 + i // 3 % 9 * 3) for i in range(270)], "id long, chapter long, anchor long")
    known = {r.id: r for r in pool.collect()}
    q = Z.order_questions(pool, pool.where("id % 10 = 0"))
    rows = q.collect()
    assert len(rows) == 27
    for r in rows:
        assert r["items"][0]["id"] == r.seed and len({x["id"] for x in r["items"]}) == 4
        for x in r["items"]:
            assert known[x["id"]].anchor == x["anchor"] and abs(known[x["id"]].chapter - known[r.seed].chapter) <= 1
            assert sum(abs(x["anchor"] - y["anchor"]) < 2 for y in r["items"]) == 1
    assert len({x["id"] for r in rows for x in r["items"][1:]}) > 40
    assert "count(1)" in q._jdf.queryExecution().optimizedPlan().toString()


def test_tree_paths_take_rounds_not_levels(spark):
    """a chain of 40 needs as many tables as its depth has bits; cycles and missing parents are not reached."""
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(41)] + [(50, 51), (51, 50), (52, 50), (61, 60)], "id long, parent long")
    kept, R.keep = R.keep, lambda df: tables.append(1) or kept(df)
    tables = []
    try:
        rows = R.tree_paths(nodes).collect()
    finally:
        R.keep = kept
    assert {r.id: (r.root, r.depth, r.path) for r in rows} == {i: (0, i, list(range(i + 1))) for i in range(41)} and len(rows) == 41
    assert len(tables) <= 7


def test_copies_of_events_are_one_kind(spark, tmp_path):
    """parts of one title and start meet others as one kind, and all their pairs come out."""
    part = "SELECT (i % 5 + i // 5 * 3300)::BIGINT AS p_partkey, CASE WHEN i % 5 % 2 = 0 THEN 'old plate' ELSE 'hot bolt' END AS p_name FROM range(40) r(i)"
    agree(spark, tmp_path, "duplicate_candidates", part=part)
    _, pairs = R.alike_kinds(catalog_links._events(catalog.Tables(spark, str(tmp_path))))
    kinds = pairs.collect()
    assert len(kinds) <= 15 and all(r.p <= r.q for r in kinds) and len({(r.p, r.q) for r in kinds}) == len(kinds)


def test_neighbours_sort_few(monkeypatch):
    """of a block's similarities only those that can be among the k best are sorted; ties, zeros and lost values as before."""
    r = np.random.default_rng(5)
    v = np.tile(r.normal(size=(500, 16)), (4, 1))
    v[3], v[9] = np.nan, 0
    ids, k, sizes = r.permutation(2000), 5, []
    sort = np.lexsort
    monkeypatch.setattr(V.np, "lexsort", lambda keys, **how: sizes.append(np.size(keys[0])) or sort(keys, **how))
    got = [np.concatenate(x) for x in zip(*V._nearest(ids, v, ids, v, k))]
    monkeypatch.undo()
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    want = [(ids[i], ids[j]) for i in range(len(v)) for j in np.lexsort((ids, -np.round(sims[i], 9)))[:k] if np.isfinite(sims[i, j])]
    assert list(zip(*got[:2])) == want and sum(sizes) < len(v) * 200


def test_cached_neighbours_are_made_once(spark):
    """the cached lists, which may be a search, are worked out once, however often they are read."""
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)], "id long, vector array<double>").withColumn("vector", V.normalise(V.F.col("vector")))
    before, now = v.where("id % 10 <> 7"), v.where("id % 10 <> 3")
    cached = V.knn(before, before, 3).select("id", "neighbour", "sim").mapInPandas(told, "id long, neighbour long, sim double")
    got = V.update_neighbours(cached, now, 3).select("id", "neighbour", "rank").collect()
    assert made.value == 36 * 3
    assert sorted(got) == sorted(V.knn(now, now, 3).select("id", "neighbour", "rank").collect())


def test_entries_of_a_year_ask_as_one(spark, tmp_path, monkeypatch):
    """entries of a page and year want the same paragraphs; no table holds a row for each entry and paragraph."""
    from almanack.operators import extract as E

    sizes = []
    monkeypatch.setattr(E, "keep", lambda df, kept=E.keep: [d := kept(df), sizes.append(d.count())][0])
    part = "SELECT (i % 40 * 300 + i // 40)::BIGINT AS p_partkey, (i * 7 % 50)::INT AS p_size FROM range(80) r(i)"
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 2 + i % 3 * 300)::BIGINT AS o_custkey, TIMESTAMP '1992-05-01' + to_days((i * 37 % 2400)::INT) AS o_orderdate FROM range(900) r(i)"
    agree(spark, tmp_path, "assigned_paragraphs", part=part, orders=orders)
    assert max(sizes) <= 80 * 7 * 4


def test_pages_of_a_small_table_are_read_by_many_tasks(spark):
    """a table in one small file is dealt over many tasks before its pages are parsed."""
    for name in ("article_sections", "table_events", "mined_tables", "prose_links", "box_members"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name


def test_members_of_kinds_are_linked_not_paired(spark, tmp_path, monkeypatch):
    """of the members of alike kinds as many links are made as join them, not one a pair; groups are those of the SQL."""
    from almanack.operators import graphs as G

    seen, found = [], G.components
    monkeypatch.setattr(G, "components", lambda edges: seen.append(edges.count()) or found(edges))
    part = "SELECT (i // 5 * 3300 + [0, 1, 60, 301, 2970][1 + i % 5])::BIGINT AS p_partkey, CASE WHEN i % 5 % 2 = 0 THEN 'old plate' ELSE 'hot bolt' END AS p_name FROM range(300) r(i)"
    agree(spark, tmp_path, "merged_events", part=part)
    assert seen[0] <= 300 * 4
    e = spark.createDataFrame([(i, "Old plate of Town", 1000, False, 0.1, None, None) for i in range(6)], "id long, title string, start int, prose boolean, importance double, excerpt string, image string")
    judged = spark.createDataFrame([(0, i, False) for i in range(1, 6)], "a long, b long, same boolean")
    assert sorted((r.id, r.also_told) for r in R.merge_duplicates(e, judged).collect()) == [(0, 0), (1, 4)]


def test_long_tables_are_read_row_by_row(spark):
    """lines of a table come out while it is read, the same as of whole tables; the page is parsed once."""
    import tracemalloc

    from almanack.operators import results, tables

    row = "<tr><td rowspan=2>1901<sup>[1]</sup></td><td><b>A &amp; b</b><table><tr><th>x</th></tr><tr><td>y</td></tr></table></td></tr><tr><td>c</td></tr>"
    page = "<table><tr><th>Year</th><th>Winners</th></tr>" + row * 5_000 + "</table><table><tr><td>open"
    grids, got = {t: g for t, g in enumerate(tables.marked_grids(page)) if g}, {}
    for t, i, line in tables.marked_lines(page):
        assert got.setdefault(t, []) is not None and len(got[t]) == i
        got[t].append(line)
    assert got == grids
    tracemalloc.start()
    assert sum(1 for _ in tables.marked_lines(page)) == sum(map(len, grids.values()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8e6
    pages = spark.createDataFrame([(1, "Cup 0", "<table><tr><th>Year</th><th>Winners</th></tr><tr><td>1990</td><td>A</td></tr></table>")], "page long, title string, html string")
    won = results.mine_results(pages, spark.createDataFrame([("Cup 0", "the cup", *[None] * 10)], results.RECIPE), 2026)
    assert [r.title for r in won.collect()] == ["A win the cup"] and "MapIn" not in won._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_words_once(spark):
    """the words of a text are worked out once, not again for each phrase; texts of a small file are dealt over tasks."""
    from almanack.operators import lookup as L

    texts = spark.createDataFrame([(1, "The Siege of Old Town, told"), (2, ""), (3, None), (4, "old  town")], "id long, text string")
    said = texts.select("id", L.phrases(L.F.col("text"), 3).alias("p"))
    assert said._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r.id: r.p for r in said.collect()}[4] == ["old", "town", "old town"]
    titles = spark.createDataFrame([(7, "Old Town (place)"), (8, "Siege of Old"), (9, "Town old")], "target long, title string")
    assert sorted(tuple(r) for r in L.named_in(texts, titles).collect()) == [(1, 7), (1, 8), (4, 7)]


def test_cards_of_a_full_page_are_placed_by_bits():
    """a card asks for its first free row at once, not row by row and card by card; what only touches or has no width is as before."""
    import time

    from almanack.operators import layout as L

    def card(i, a, b, height=1, line=None):
        return {"id": i, "left": a, "right": b, "height": height, "line": line}

    few = [card(1, 0, 10), card(2, 10, 20, 2), card(3, 5, 5), card(4, 10, 10), card(5, 0, 20, 2), card(6, 20, 25, 1, (0, 30)), card(7, 4.5, 4.75, 3)]
    assert L.pack_cards(few, 6, [card(8, 3, 6, 2), card(9, 30, 31)]) == {1: 0, 2: 0, 3: 1, 4: 0, 5: 2, 6: 0, 7: 4, 9: 0}
    begun = time.process_time()
    assert L.pack_cards([card(i, 0, 1) for i in range(20_000)]) == {i: i for i in range(20_000)}
    assert time.process_time() - begun < 5


def test_texts_of_pages_are_read_once(spark):
    """lines and sentences are found by one pass over the lines, and events and what is refused come from one table of it."""
    body = "1850 – the first railway opened here\n== 1871 ==\nthe town hall was built of red stone\nIt was quiet. In 1903 a great fire destroyed the whole of the old town. Nobody knew.\n== The first millennium BC ==\n100–110 – order 12 told backwards"
    pages = spark.createDataFrame([(1, "Town", body)], "page long, title string, body string")
    found = M.candidates(M.page_lines(pages))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") <= 4
    told = [(r.n, r.m, r.tier, r.date["text"], r.chunk) for r in found.orderBy("n", "m").collect()]
    assert told[0] == (0, 0, 1, "1850", "1850 – the first railway opened here") and told[1][:4] == (2, 0, 1, "1871") and told[1][4].startswith("1871 – the town hall")
    events, refused = M.mine_events(pages)
    assert "timeline_sentences" not in events._jdf.queryExecution().optimizedPlan().toString()
    assert [r.reason for r in refused.collect()] == ["backwards span"] and len(events.collect()) >= 2


def test_blocks_of_rows_share_folders(spark, tmp_path):
    """A layout has a folder for a thousand blocks of rows, not one for each; numbers still find their rows."""
    import os

    from almanack.sources import store as T

    e = spark.range(1200).selectExpr("id", "1900 + id % 7 AS start", "CAST(NULL AS LONG) AS end", "false AS open_ended", "'a' AS topic", "CAST(id AS DOUBLE) AS fame", "true AS has_image")
    T.write_layout(e, str(tmp_path / "l"), 300, 2026, block=1)
    assert sum(d.startswith("block") for d in os.listdir(tmp_path / "l" / "rows")) == 2
    numbers = spark.createDataFrame([(0,), (999,), (1000,), (1199,)], "n long")
    assert sorted((r.n, r.id) for r in T.rows_by_number(spark, str(tmp_path / "l"), numbers, per=1).collect()) == [(0, 1199), (999, 200), (1000, 199), (1199, 0)]


def test_people_of_one_name_meet_in_tiles(spark, tmp_path, monkeypatch):
    """F8: equal titles and people of one name meet as kinds and are spelt out in blocks; letters beyond z and 255 are those that the SQL has."""
    from almanack.operators import lookup as L

    monkeypatch.setattr(L, "BLOCK", 4, raising=False)
    keys = "(SELECT unnest(list_concat(range(70), [17579, 17581, 18259, 43943, 69983, 107483, 109511, 400003, 540803, 17650, 675997]))::BIGINT AS k)"
    agree(spark, tmp_path, "people_in_titles", customer=f"SELECT k AS c_custkey FROM {keys}", orders=f"SELECT (k * 4 + j)::BIGINT AS o_orderkey, k AS o_custkey FROM {keys}, range(4) r(j)")
    plan = catalog.QUERIES["people_in_titles"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    assert "collect_list" in plan.toString()
    people = spark.createDataFrame([(1, "Isaac Newton"), (2, "James (poet)"), (3, "Ann Bee"), (4, "Tom Bee"), (5, "Isaac Newton (jr)"), (6, "J. R. Stone")], "person long, name string")
    titles = spark.createDataFrame([(1, "Newton's laws"), (2, "James' tale"), (3, "Jameson"), (4, "of Ann Bee, by Tom Bee"), (5, "Isaac Newton"), (6, "J R Stone"), (None, "Stone's wall"), (7, "stone"), (8, None), (9, "Ann  Bee")], "id long, text string")
    assert sorted((r.id or 0, r.person) for r in L.people_in_titles(people, titles).collect()) == [(0, 6), (2, 2), (4, 3), (4, 4), (5, 1), (5, 5), (6, 6)]


def test_jumps_over_bins_hold_no_nulls(spark, monkeypatch):
    """an item after which no bin opens has no row in the jumps, since all nulls would be sorted by one task; one bin, and none, come out too."""
    from almanack.operators.layout import next_fit
    from almanack.sources import store as T

    kept, keep = [], T.keep
    monkeypatch.setattr(T, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    sizes = [1 + i * 7 % 40 + (500 if i % 97 == 0 else 0) for i in range(300)]
    for n in (300, 2, 1, 0):
        items = spark.createDataFrame(list(enumerate(sizes[n and 1 : n + 1] if n < 300 else sizes)), "id long, size long").where(f"id < {n}")
        rows = T.next_fit(items, 200, T.F.asc("id")).collect()
        assert [r.bin for r in sorted(rows)] == next_fit([r.size for r in sorted(rows)], 200) and len(rows) == n
    jumps = [df for df in kept if df.columns == ["i", "j"]]
    assert len(jumps) > 4 and not any(df.where("j IS NULL").count() for df in jumps)


def test_terms_of_a_small_table_are_weighed_by_many_tasks(spark, tmp_path):
    """rows are dealt by id before their terms are counted, so no task holds the terms of a whole file; an id that comes twice counts as in the SQL."""
    agree(spark, tmp_path, "weighted_terms", part="SELECT i::BIGINT AS p_partkey, ['hot bolts', 'old glass case plates', 'cold bolt'][i % 3 + 1] AS p_name, ['PLATED', 'SMALL'][i % 2 + 1] AS p_type FROM range(90) r(i)")
    from almanack.operators import search as X

    F = X.F
    rows = spark.createDataFrame([(i, "a b a") for i in [*range(400), 7]], "id long, t string").coalesce(1)
    out = X.weighted_terms(rows, [(F.split("t", " "), 1.0)], F.lit(1.0), F.lit(False))
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}) > 1
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted((r.term, r.weight) for r in out.where("id = 7").collect()) == [("a", 0.769), ("b", 0.625)] and out.count() == 800


def test_reviews_of_a_user_ask_the_state_store_once():
    """what a batch brings for a user is one read and one write of state, however many entries it is about; a due time has one notice."""
    from types import SimpleNamespace as N

    from almanack.streaming.progress import WAITS, _Reviewer

    kept, timers, calls = [None], set(), []
    state = N(get=lambda: calls.append("get") or kept[0], update=lambda v: calls.append("update") or kept.__setitem__(0, v), exists=lambda: kept[0] is not None)
    r = _Reviewer("string")
    r.init(N(getValueState=lambda *a: state, registerTimer=timers.add, deleteTimer=timers.remove))
    rows = [N(entry=f"e{i % 5}", at=i, event_id=i, right=i % 7 > 0) for i in range(100)]
    first = list(r.handleInputRows((1,), iter(rows), None))
    assert len(first) == 5 and calls == ["get", "update"] and len(timers) == 1
    at = lambda t: (N(getCurrentWatermarkInMs=lambda: t), N(getExpiryTimeInMs=lambda: min(timers)))
    sent = list(r.handleExpiredTimer((1,), *at(WAITS[-1] * 2)))
    assert sorted((x.entry, x.due) for x in sent) == sorted((x.entry, x.due) for x in first)
    timers.clear()
    again = list(r.handleInputRows((1,), iter([N(entry="e1", at=1, event_id=1000, right=True)]), None))  # late, moves nothing
    assert [x.due for x in again] == [x.due for x in first if x.entry == "e1"] and not timers


def test_terms_of_texts_are_counted_once(spark, tmp_path, monkeypatch):
    """the counts of the terms of texts aren't grouped again for the index."""
    from almanack.operators import search as X

    kept, keep = [], X.keep
    monkeypatch.setattr(X, "keep", lambda df: kept.append(df) or keep(df))
    agree(spark, tmp_path, "inverted_index", documents="SELECT i::BIGINT AS doc_id, 'the old bolt, the bolt x' || i % 3 AS text FROM range(20) r(i)")
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for df in kept] == [1]
