"""Faults found by the fourth review, each on the smallest tables that showed it, against the query's SQL where it has one."""

from almanack.operators import events as M
from almanack.plans import catalog, catalog_links, catalog_mining, catalog_text  # noqa: F401
from tests.test_findings_r03 import agree


def test_style_reasons_of_odd_openings_and_white_space(spark, tmp_path):
    """a text that merely opens with a word of a refusal, as "Here is" or "sure,", is none to the SQL; a vertical tab is no white space, and U+0001 parts sentences."""
    heads = ["Here is thing eres ble.", "Sorryth in", "sure, ", "Sure, ", "- a", "-\x0bb", "\x0b- c", "#\x0bd", "\x0be\x0b", "One.\x0btwo. Three. Four.", "One.\x01two. Three\x01four."]
    values = ", ".join("'" + "".join(f"' || chr({ord(c)}) || '" if c < " " else c for c in h) + "'" for h in heads)
    agree(spark, tmp_path, "style_reasons", documents=f"SELECT (i * 7 + j)::BIGINT AS doc_id, [{values}][i % {len(heads)} + 1] || repeat('word ', (i // {len(heads)}) * 3) AS text, (j * 90)::INT AS n_chars FROM range({len(heads) * 8}) r(i), range(7) s(j)")


def test_all_events_of_a_page_are_mined(spark, tmp_path):
    """a page, a document and a customer with more than 400 events of a tier have them all; each is told once, by its most trusted tier."""
    import duckdb

    said = {"pages": "SELECT 1::BIGINT AS page_id, 'u' AS url, '<p>no year</p>' AS html", "documents": "SELECT 1::BIGINT AS doc_id, string_agg('It was said that in ' || (1000 + i) || ' the bell number ' || i || ' was cast here.', ' ') AS text FROM range(450) r(i)"}
    said["orders"] = "SELECT (9 * i)::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, '1-URGENT' AS o_orderpriority, DATE '1995-01-02' AS o_orderdate FROM range(450) r(i)"
    for table, sql in said.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    rows = catalog.QUERIES["mined_events"](spark, str(tmp_path)).collect()
    assert [sum(r.tier == k for r in rows) for k in ("mined-line", "mined-prose")] == [450, 450] and len({(r.start, r.name) for r in rows}) == 900
    assert len(catalog.QUERIES["chronicle_events_once"](spark, str(tmp_path)).collect()) == 450
    body = "In the year 1905 long ago the paper on light quanta was printed.\n1905 – In the year 1905 long ago the paper on light quanta was printed."
    pages = spark.createDataFrame([(1, "p", body)], "page long, title string, body string")
    found, _ = M.mine_events(pages)
    capped, _ = M.mine_events(pages, limit=400)
    assert sorted(found.collect()) == sorted(capped.collect())


def test_pages_of_results_come_in_parts(spark, monkeypatch):
    """a page that comes in parts has the tables of the whole page, however it is cut, and no more than a piece of it is held."""
    import random

    from almanack.operators import results as R, tables as T

    row = "<tr><td rowspan=2>19{0}<sup>[1]</sup></td><td><b>A{0} &amp; b</b><table><tr><th>Year</th><th>Winner</th></tr><tr><td>1850</td><td>y{0}</td></tr></table></td></tr><tr><td>C{0}</td></tr>"
    page = "<table><tr><th>Year</th><th>Winners</th></tr>" + "".join(row.format(i) for i in range(10, 60)) + "</table><!-- <table> --><table><tr><th>Year</th><th>Winner</th></tr><tr><td title='<b>'>1990</td><td>open"
    rand = random.Random(1)
    cuts = [0, *sorted(rand.sample(range(1, len(page)), 400)), len(page)]
    parts = [page[a:b] for a, b in zip(cuts, cuts[1:])]
    assert "".join(T._pieces(parts, 50)) == page == "".join(T._pieces([page], 50)) and max(map(len, T._pieces(parts, 50))) < 200
    want = {t: g for t, g in enumerate(T.marked_grids(page)) if g}
    for least in (1, 50, 1 << 16):
        monkeypatch.setattr(T._pieces, "__defaults__", (least,))
        got, place = {}, {}
        for t, i, line in T.streamed_lines(parts):
            if i is None:
                place[t] = line
            else:
                got.setdefault(t, []).append(line)
        assert {place[t]: g for t, g in got.items()} == want
    monkeypatch.setattr(T._pieces, "__defaults__", (1 << 16,))

    every = spark.createDataFrame([("Cup", "the cup", *[None] * 7, True, None, None), ("One", "the cup", *[None] * 10)], R.RECIPE)
    cut = [(p, t, i, h) for p, t in ((1, "Cup"), (2, "One"), (3, "None")) for i, h in enumerate(parts)]
    rand.shuffle(cut)
    whole = R.mine_results(spark.createDataFrame([(1, "Cup", page), (2, "One", page), (3, "None", page)], "page long, title string, html string"), every, 2026).collect()
    assert sorted(R.mine_results(spark.createDataFrame(cut, "page long, title string, part int, html string"), every, 2026).collect()) == sorted(whole)
    assert {r.page for r in whole} == {1, 2} and len([r for r in whole if r.page == 2]) == 100 and len(whole) == 251


def test_no_page_of_results_is_put_together(spark, tmp_path, monkeypatch):
    """the rows of a page are never one value, neither collected nor in the HTML that is parsed."""
    from almanack.operators import results as R

    plans = []
    monkeypatch.setattr(R, "keep", lambda df, keep=R.keep: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    orders = "SELECT i::BIGINT AS o_orderkey, (i % 40)::BIGINT AS o_custkey, (DATE '1992-01-01' + INTERVAL (i * 9) DAY)::TIMESTAMP AS o_orderdate FROM range(300) r(i)"
    agree(spark, tmp_path, "recipe_results", orders=orders)
    assert plans and not any("collect_list" in plan for plan in plans)


def test_pairs_of_a_tile_are_handed_on_title_by_title(spark):
    """the two explosions of a tile aren't compiled into one loop, which would hold a million pairs at once; all pairs come, those with nulls too."""
    from almanack.operators import lookup as L

    people = spark.range(2500).selectExpr("IF(id = 7, NULL, id) AS person", "'Ann Surone' AS name").unionByName(spark.createDataFrame([(5000, "Tom Beech")], "person long, name string"))
    titles = spark.range(2300).selectExpr("IF(id = 9, NULL, id) AS id", "'Death of Ann Surone' AS text").unionByName(spark.createDataFrame([(6000, "Reign of Beech"), (6001, "Reign of Beecher")], "id long, text string"))
    df = L.people_in_titles(people, titles)
    steps = [s for line in df._jdf.queryExecution().executedPlan().toString().splitlines() for s in ("explode(persons", "Coalesce", "explode(ids") if s in line]
    assert steps == ["explode(persons", "Coalesce", "explode(ids"]
    got = df.selectExpr("count(*)", "count(id)", "count(person)", "sum(id)", "sum(person)", "count(DISTINCT person)").collect()[0]
    ids, persons = [i for i in range(2300) if i != 9], [i for i in range(2500) if i != 7]
    assert tuple(got) == (2300 * 2500 + 1, len(ids) * 2500 + 1, len(persons) * 2300 + 1, sum(ids) * 2500 + 6000, sum(persons) * 2300 + 5000, 2500)
