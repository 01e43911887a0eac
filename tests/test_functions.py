"""Golden cases of the functions, sources and filters."""

import pytest

from almanack.functions.dates import find_date_text, parse_years_text

YEARS = [
    ("66 Ma", -66000000, -66000000), ("c. 4,570 Ma", -4570000000, -4570000000), ("4.54 billion years ago", -4540000000, -4540000000),
    ("541 to 485 million years ago", -541000000, -485000000), ("252-201 Ma", -252000000, -201000000), ("320 kya – 305 kya", -320000, -305000),
    ("2 Ma – 500 ka", -2000000, -500000), ("c. 4,567 ±3 Ma", -4567000000, -4567000000), ("11,700 BP", -9750, -9750), ("300,000 years ago", -300000, -300000),
    ("3000 BC", -3000, -3000), ("1879-1955", 1879, 1955), ("27 BC - 14 AD", -27, 14), ("c. 251.9 Ma ± 0.024 Ma", -251900000, -251900000),
    ("1601–03", 1601, 1603), ("1899-01", 1899, 1901), ("180–10 AD", -180, 10), ("between 1850 and 1900", 1850, 1900), ("c. 3200 – c. 2650 BC", -3200, -2650),
    ("1913 to 170", 1913, 170),
]


@pytest.mark.parametrize("text,start,end", YEARS)
def test_years(text, start, end):
    assert parse_years_text(text) == (start, end)


FOUND = [
    ("default", "flora recovered over 1.7 million years", None), ("default", "diversifying approximately 30 million years after the event", None),
    ("default", "the impact 66 million years ago", "66 million years ago"), ("default", "the Judith River Formation at 75 Ma", "75 Ma"),
    ("default", "It has 400 members and covers 12 states", None), ("anchored", "1066, the Norman conquest of England", "1066"),
    ("anchored", "1914–1918, the Great War", "1914–1918"), ("default", "published in 1900, he said", "1900"), ("anchored", "1920s Droughts on Euboea", "1920s"),
    ("default", "1,900 members attended", None), ("default", "the figure rose to 1955.5 units", None), ("loose", "Planck won the 1918 Nobel Prize", "1918"),
    ("loose", "the planetary model of the atom (1911).", "1911"), ("loose", "Throughout the 1800s many studies", "1800s"),
    ("loose", "between 1850 and 1900, which", "1850 and 1900"), ("loose", "It has 400 members and covers 12 states", None),
    ("loose", "the tunnel runs 1500 metres beneath the ridge", None), ("loose", "a crowd of 2000 people gathered", None), ("loose", "a print run of 1,200 copies", None),
]


@pytest.mark.parametrize("mode,text,want", FOUND)
def test_found_dates(mode, text, want):
    assert find_date_text(text, mode) == want


def test_strings(spark):
    from pyspark.sql import functions as F

    from almanack.functions import dates as D, strings as S

    one = spark.range(1)
    lit = F.lit
    row = one.select(
        S.slugify(lit("Émile Zola's “Łódź”!")).alias("a"), S.entry_id(lit("people"), lit("Julius Caesar"), lit(-44)).alias("b"),
        S.dedupe_lower(lit("War | peace; WAR / ")).alias("c"), S.tokenize(lit("The cities of Paris, 7 classes")).alias("d"),
        S.first_sentence(lit("One two. Three four.")).alias("e"), S.clip(lit("alpha beta gamma"), 12).alias("f"), S.fnv1a(lit("a")).alias("g"),
        D.year_label(lit(-66000000)).alias("h"), D.year_label(lit(-44)).alias("i"), D.parse_era_year(lit("c. 1,200 BC")).alias("j"),
        D.time_range(lit(1850), lit(7)).alias("k"), D.anchor_year(lit(1879), lit(1955), lit(True)).alias("l"), D.typed_years(lit("1914-18")).alias("m"),
        S.title_similarity(lit("Battle of Hastings (1066)"), lit("The battle of Hastings")).alias("n"), D.tick_step(lit(0.3)).alias("o"),
        S.answer_matches(lit("zola"), lit("Émile Zola")).alias("p"), S.answer_matches(lit("ran"), lit("France")).alias("q"), S.shard_of(lit("é")).alias("r"),
        D.parse_years(lit("27 BC - 14 AD")).alias("s"),
    ).first()
    assert row.a == "emile-zolas-lodz" and row.b == "people:julius-caesar:44bc" and row.c == ["war", "peace"]
    assert row.d == ["city", "paris", "7", "classe"] and row.e == "One two." and row.f == "alpha beta" and row.g == 0xE40C292C
    assert row.h == "66 million years ago" and row.i == "44 BC" and row.j == -1200 and tuple(row.k) == (1801, 1900) and row.l == 1925 and row.m == [1914, 18]
    assert row.n == 1.0 and row.o == 500 and row.p and not row.q and row.r == "__" and tuple(row.s) == (-27, 14)


def test_small_fixtures(spark):
    from pyspark.sql import functions as F

    from almanack.operators import resolve as R, search as X, temporal as T, vectors as V

    kw = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "id string, score double")
    sem = spark.createDataFrame([("b", 0.9), ("d", 0.8)], "id string, sim double")
    got = {r.id: r.score for r in X.fuse(kw, sem).collect()}
    assert sorted(got, key=lambda x: -got[x]) == ["b", "d", "a", "c"] and abs(got["a"] - 0.9 / 60) < 1e-12 and abs(got["b"] - 0.9 / 61 - 1 / 60) < 1e-12
    counts = spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "k int, n int")
    assert {r.k: r.bucket for r in T.equal_buckets(counts, "k", "n", 2).collect()} == {1: 0, 2: 1, 3: 1}
    q = spark.range(1).select(V.quantise(F.array(F.lit(0.5), F.lit(-1.0), F.lit(0.0))).alias("q")).first().q
    assert abs(q.scale - 1 / 127) < 1e-12 and list(q.q) == [64, -127, 0]
    alias = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {r.src: r.dst for r in R.resolve_aliases(alias).collect()} == {"a": "c", "b": "c", "x": "y"}


def test_filter_language(spark):
    from almanack.operators.filters import parse, run

    f = parse("rome 100 to 200 ds:art topic:ancient_history has:image")
    assert (f.text, f.years, f.datasets, f.topics, f.has) == (["rome"], (100, 200), ["art"], ["ancient history"], ["image"])
    rows = spark.createDataFrame(
        [("Rome", "", "Art", "s", "Europe", ["Ancient history"], "i.png", 150, None, False, {}), ("Rome", "", "art", "s", "Asia", [], None, 150, None, False, {})],
        "title string, subtitle string, dataset string, subject string, region string, topics array<string>, image string, start long, end long, open_ended boolean, facets map<string, array<string>>",
    )
    assert run(rows, "rome 100 to 200 ds:art topic:ancient_history has:image").count() == 1
    assert run(rows, "rome 151-200").count() == 0 and run(rows, "").count() == 2 and run(rows, "region:asia").count() == 1


def test_sources(spark, tmp_path):
    from almanack.sources.text import clean_html, read_blocks, read_entries, read_job_list, write_entries
    from pyspark.sql import functions as F

    (tmp_path / "jobs.txt").write_text("# note\nFrance | name=The French; French | key=yes\n1888..1890 in film\n")
    jobs = {r.name: r.options for r in read_job_list(spark, f"{tmp_path}/jobs.txt").collect()}
    assert set(jobs) == {"France", "1888 in film", "1889 in film", "1890 in film"} and jobs["France"]["name"] == ["The French", "French"]
    (tmp_path / "blocks.txt").write_text("Title one\nyear: 1900\nbody a\nbody b\n\nTitle two\nbody c\n")
    assert [tuple(r) for r in read_blocks(spark, f"{tmp_path}/blocks.txt").collect()] == [("Title one", "1900", "body a\nbody b"), ("Title two", None, "body c")]
    (tmp_path / "e.json").write_text('{"id": "a", "start": -44, "topics": ["x"], "facets": {"k": ["v"]}}\n{"id": "b"\n')
    rows = read_entries(spark, f"{tmp_path}/e.json").cache()
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1 and rows.where("id = 'a'").first().start == -44
    write_entries(rows.where("id = 'a'").drop("_corrupt_record"), f"{tmp_path}/out")
    assert read_entries(spark, f"{tmp_path}/out").count() == 1
    page = spark.range(1).select(clean_html(F.lit("<html><script>x()</script><p>One &amp; two</p><div>three</div></html>")).alias("t")).first().t
    assert page == "One & two\nthree"


def test_progress(spark):
    from almanack.streaming.progress import fold_reviews, merge_latest

    reviews = spark.createDataFrame([(1, "e", 10, 1, True), (1, "e", 20, 2, False), (1, "e", 30, 3, True), (2, "e", 5, 4, False)] + [(3, "e", i, i, True) for i in range(9)], "user int, entry string, at long, event_id long, right boolean")
    got = {r.user: (r.right_n, r.wrong_n, r.box, r.due) for r in fold_reviews(reviews).collect()}
    assert got == {1: (2, 1, 1, 30 + 86_400_000), 2: (0, 1, 0, 5 + 600_000), 3: (9, 0, 6, 8 + 90 * 86_400_000)}
    a, b = spark.createDataFrame([(1, 5), (2, 5)], "key int, at long"), spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "key int, at long")
    assert {r.key: (r.at, r.side) for r in merge_latest(a, b).collect()} == {1: (5, "local"), 2: (6, "remote"), 3: (1, "remote")}


def test_layout_and_tables():
    from almanack.operators.layout import first_fit, next_fit
    from almanack.operators.tables import grids, table_events

    assert first_fit([(0, 10), (5, 10), (10, 5), (6, 2)], 2) == [0, 1, 0, None]
    assert next_fit([100, 90, 20, 250, 1], 200) == [0, 0, 1, 2, 3]
    html = "<table><tr><th>Year</th><th>Event</th></tr><tr><td rowspan=2>1914</td><td>War begins &amp; spreads</td></tr><tr><td>A second thing</td></tr><tr><td>44 BC</td><td>Caesar dies</td></tr></table>"
    assert grids(html) == [[["Year", "Event"], ["1914", "War begins & spreads"], ["1914", "A second thing"], ["44 BC", "Caesar dies"]]]
    assert table_events(html) == [(1914, 1914, "War begins & spreads"), (1914, 1914, "A second thing"), (-44, -44, "Caesar dies")]
    assert table_events("") == [] and grids("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>")


def test_samples(spark):
    from almanack.operators import ranking as K
    from pyspark.sql import functions as F

    rows = spark.range(100).withColumns({"w": F.when(F.col("id") < 5, 1000.0).otherwise(0.001), "g": F.col("id") % 2})
    assert {r.id for r in K.weighted_sample(rows, "id", "w", 5).collect()} == set(range(5))
    assert [r.id for r in K.stride_sample(rows, "g", ["id"], 5).where("g = 0").orderBy("id").collect()] == [0, 20, 40, 60, 80]
    named = spark.createDataFrame([(1000,), (1240,), (3000,)], "y int").select(K.chapter_of(F.col("y"), [("a", 900, 1100), ("b", 1100, 1200)]).alias("c"))
    assert [r.c for r in named.collect()] == ["a", None, None]


def test_kmeans_seeds_over_all_rows(spark):
    from almanack.operators.vectors import spherical_kmeans

    # four rows of 5,000 point elsewhere
    rows = spark.range(5000).selectExpr("id", "IF(id % 1250 = 7, array(0d, 1d, 0d), array(1d, 0d, 0d)) AS vector")
    got = spherical_kmeans(rows, 2).collect()
    far = {r.cluster for r in got if r.id % 1250 == 7}
    assert len(got) == 5000 and len(far) == 1 and not far & {r.cluster for r in got if r.id % 1250 != 7}
    assert all(r.sim > 0.999999 for r in got)


def test_found_dates_over_documents(spark, tmp_path):
    from almanack.plans import catalog

    texts = ["Rome was founded in 753 BC by two. It held 1500 people. The war of 1914 began.\nIt ended in 1918.", "Nothing here", None, "Life began 3 million years ago."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.first_year, r.spans) for r in catalog.QUERIES["found_dates"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts[:2]):
        found = [find_date_text(s, "loose") for s in text.replace("\n", " ").replace(". ", ".|").split("|")]
        want = [(f, *parse_years_text(f)) for f in found if f]
        assert [tuple(x) for x in got[i][2]] == want and got[i][0] == len(want)
    assert got[0][:2] == (3, -753) and [x.start for x in got[0][2]] == [-753, 1914, 1918]
    assert got[3][0] == 1 and got[3][1] < -2_900_000 and got[2][1] is None
