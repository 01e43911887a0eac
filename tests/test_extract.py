"""Choices with capacities against serving one by one, and mined events against their lines."""

import random


def test_deferred_acceptance_equals_serving_one_by_one(spark):
    from almanack.operators.extract import capped_choice

    rng = random.Random(5)
    for most in (1, 3):
        wants = [(g, 1000 * g + i, rng.randrange(20), rng.sample(range(12), rng.randint(0, 6))) for g in range(5) for i in range(rng.choice([1, 4, 60]))]
        taken, want = {}, {}
        for g, i, _, pages in sorted(wants, key=lambda w: (w[0], w[2], w[1])):
            free = [p for p in pages if taken.get((g, p), 0) < most]
            if free:
                want[i] = free[0]
                taken[g, free[0]] = taken.get((g, free[0]), 0) + 1
        got = capped_choice(spark.createDataFrame(wants, "group long, id long, seq long, pages array<long>"), most).collect()
        assert {r.id: r.page for r in got} == want and len(got) == len(want)
    assert capped_choice(spark.createDataFrame([], "group long, id long, seq long, pages array<long>")).count() == 0


def test_a_hot_page_of_many_entries(spark):
    """All ids want the same pages in the same order: each page takes its number, in order, and the rest go without."""
    from almanack.operators.extract import capped_choice

    wants = spark.range(5000).selectExpr("1L AS group", "id", "5000 - id AS seq", "array(1L, 2L, 3L) AS pages")
    assert {r.id: r.page for r in capped_choice(wants).collect()} == {4999 - i: i // 3 + 1 for i in range(9)}


def test_paragraphs_by_price(spark):
    from almanack.operators.extract import assign_paragraphs

    entries = spark.createDataFrame([(0, i, 1900) for i in range(6)], "page long, id long, year int")
    paras = spark.createDataFrame([(0, 1, [1900], 0.2), (0, 2, [1900], 0.1), (0, 3, [1800], 0.0)], "page long, paragraph long, years array<int>, weight double")
    # prices 0, .12, .24, .35: 1 at 1.23, 2 at 1.13, 1 at 1.11, 2 at 1.01, 1 at .99, 2 at .89 or 1 at .88
    assert {r.id: r.paragraph for r in assign_paragraphs(entries, paras).collect()} == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1, 5: 2}


def events(spark, *pages, **options):
    from almanack.operators.events import mine_events

    found, refused = mine_events(spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(pages)], "page long, title string, body string"), **options)
    return sorted((r.page, r.tier, r.start, r.end, r.year_text, r.name) for r in found.collect()), sorted((r.page, r.reason) for r in refused.collect())


def test_heading_context(spark):
    body = "== c. 450 BC ==\nLeucippus proposes the atom.\n== Essays ==\nNothing is dated here at all.\n== References ==\n1901 – a book about atoms\n== 1803 ==\nDalton weighs the elements [3].\n1805 – Dalton prints his table"
    found, refused = events(spark, ("Chemistry", body), ("Timeline of the 1st millennium BC", "776 – the first games are held\n44 AD – an emperor is crowned"), (None, None), ("", ""))
    assert found == [
        (0, "mined-line", -450, -450, "c. 450 BC", "Leucippus proposes the atom"), (0, "mined-line", 1803, 1803, "1803", "Dalton weighs the elements"), (0, "mined-line", 1805, 1805, "1805", "Dalton prints his table"),
        (1, "mined-line", -776, -776, "776 BC", "The first games are held"), (1, "mined-line", 44, 44, "44 AD", "An emperor is crowned"),
    ]
    assert refused == []


def test_tiers_budgets_and_refusals(spark):
    prose = "It was long said that in 1905 Einstein published the paper on light quanta."
    body = f"{prose} Later it stood still.\n1905 – Einstein publishes his paper\n1905 – einstein publishes his paper\n2.070 Ma – an unclear separator\n66.038 Ma – the great extinction\n1906 – x\n1920 – the second event\n1921 – the third event\n1910–1890: a span cut short\n== In BC ==\n480–490 – a span told backwards"
    found, refused = events(spark, ("p", body))
    assert [(f[1], f[2]) for f in found] == [("mined-line", -66038000), ("mined-line", 1905), ("mined-line", 1910), ("mined-line", 1920), ("mined-line", 1921), ("mined-prose", 1905)]
    assert refused == [(0, "ambiguous separator"), (0, "backwards span")]
    found, _ = events(spark, ("p", body), limit=2)
    assert [(f[1], f[2]) for f in found] == [("mined-line", -66038000), ("mined-line", 1905), ("mined-prose", 1905)]  # each tier has its own budget


def test_tables_come_first(spark):
    from almanack.operators.events import mine_events, table_rows

    html = "<table><tr><th>Year</th><th>Event</th></tr><tr><td rowspan=2>1914</td><td>The war begins in the east</td></tr><tr><td>The war begins in the west</td></tr></table>"
    pages = spark.createDataFrame([(0, "w", "1914 – The war begins in the east", html)], "page long, title string, body string, html string")
    found, _ = mine_events(pages, tables=table_rows(pages))
    assert sorted((r.tier, r.start, r.name) for r in found.collect()) == [("mined-table", 1914, "The war begins in the east"), ("mined-table", 1914, "The war begins in the west")]
