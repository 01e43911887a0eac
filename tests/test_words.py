"""Golden cases of the scanners that read years, sentences, names and pages."""

import numpy as np
import pytest

from almanack.functions import text as X, when as W
from almanack.operators import cluster as C, extract as E, filters as Q, layout as L

SAID = [
    ("battle of 1294", 1294, 1294, "battle of"), ("300 BC", -300, -300, ""), ("3rd millennium BC", -3000, -2001, ""), ("13th-century art", 1200, 1299, "art"),
    ("thirteenth century", 1200, 1299, ""), ("art of the 5th century bc", -500, -401, "art of the"), ("1290s", 1290, 1299, ""), ("1200s", 1200, 1299, ""),
    ("1290-99", 1290, 1299, ""), ("300-200 BC", -300, -200, ""), ("300 BC - AD 14", -300, 14, ""), ("1290 to 1300", 1290, 1300, ""), ("42 bc wars", -42, -42, "wars"),
    ("2.5 mya", -2_622_974, -2_372_974, ""), ("10,000 years ago", -8474, -7474, ""),
]


@pytest.mark.parametrize("text,lo,hi,rest", SAID)
def test_searches_that_name_a_time(text, lo, hi, rest):
    a, b, _, left = W.parse_when_text(text)
    assert (a, b, left) == (lo, hi, rest)


@pytest.mark.parametrize("text", ["42", "hello world", "", None, "9999"])
def test_searches_that_do_not(text):
    assert W.parse_when_text(text) is None


def test_filter_language():
    f = Q.parse("foo 1250 to 1200 ds:Art topic:film_noir has:image subject:Physics")
    assert (f.text, f.years, f.datasets, f.topics, f.has, f.subjects) == (["foo"], (1200, 1250), ["art"], ["film noir"], ["image"], ["physics"])
    assert Q.parse("-300 - -200").years == (-300, -200) and Q.parse("-300--200").years == (-300, -200) and Q.parse("12-5-3").years is None
    assert Q.condition(Q.parse("  ")) is None


def test_titles_and_sentences():
    assert X.title_case_text("françois o'keeffe's art") == "François O'Keeffe's Art"
    assert X.title_case_if_lower_text("the king of france") == "The King of France" and X.title_case_if_lower_text("iPhone") == "iPhone"
    assert X.timeline_sentences_text("Built c. 1500 by St. Paul. Then J. Smith left. End") == ["Built c. 1500 by St. Paul.", "Then J. Smith left.", "End"]
    found = X.article_sentences_text("J. R. Tolkien wrote. Mary I. The end of c. 1200 it was.")
    assert [s["text"] for s in found] == ["J. R. Tolkien wrote.", "Mary I.", "The end of c. 1200 it was."]
    text = "J. R. Tolkien wrote. Mary I. The end of c. 1200 it was."
    assert all(text[s["at"] : s["to"]].strip() == s["text"] for s in found)


def column(spark, f, *rows):
    """f of the columns a, b of rows."""
    from pyspark.sql import functions as F

    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in "ab"[:n]))
    return [r.x for r in df.select("i", f(*map(F.col, "ab"[:n])).alias("x")).orderBy("i").collect()]


def test_brackets_and_blanks(spark):
    said = [("Tiberius ( ty-BEER; 16 November 42 BC) was (a real one) king, (Latin: x) yes",), ("open (never closed",), (None,), ("a (b (1900–1910) c) d",), ("x (y (z) w",), ("stray ) here [1] ( )",)]
    assert column(spark, X.strip_apparatus, *said) == ["Tiberius was (a real one) king, yes", "open never closed", None, "a d", "x y (z) w", "stray ) here"]
    pairs = [("Newton laws say Newtonian law", "Newton's laws"), ("a (b) C++ c", "C++ (language)"), ("kept", None), ("kept", ""), (None, "x")]
    assert column(spark, X.mask, *pairs) == ["▁▁▁ laws say ▁▁▁ law", "a (b) ▁▁▁ c", "kept", "kept", None]

def test_dates_in_text():
    assert W.cell_date_text("1485–1603") == (1485, 1603) and W.cell_date_text("the winner") is None and W.cell_date_text("44 BC") == (-44, -44)
    assert [W.year_value_text(t) for t in ("66 Ma", "1900-1910", "none")] == [-66e6, 1905, 0]


def test_dates_in_sentences(spark):
    leads = ["It is about 560 kilometres long, built in 1200.", "500 species live here", "founded in 753 BC", "in 612", "a 612 count", None, "AD 612 it was", "In 44 BC", "700 BC and 1900", "up 50% of 1300% by 1400"]
    assert column(spark, W.year_in_lead, *[(x,) for x in leads]) == [1200, None, -753, 612, None, None, 612, None, -700, 1400]
    readings = [("1066", "He fell in 1066."), ("1066", "They had 1066 ships"), ("c. 1066", "x"), ("1066", "1066 ships"), ("1066", "no year"), ("1066", "about 1066 ships"), ("1066", "about 1066 and"), ("1066", "(1066)"), ("1066", "end of 1066"), (None, "x"), ("1066", None)]
    assert column(spark, W.reads_as_date, *readings) == [True, False, True, True, True, False, True, True, True, False, True]
    labels = ["from 3000 to 1800 BC", "around 2500 BC", "early 1900s", "(1558-1603)", "between 1900 and 1910", "in 1900", "44 BC to 14 AD", "1900", "", None, "c. 1200"]
    assert column(spark, W.tidy_year, *[(x,) for x in labels]) == ["3000–1800 BC", "c. 2500 BC", "Early 1900s", "1558–1603", "1900–1910", "1900", "44 BC–14 AD", "1900", "", None, "c. 1200"]


def test_sections_keep_links_in_place():
    html = '<p>Lead about   <a href="/wiki/Rome">Rome</a> and more words here.</p><h2>See also</h2><p>Gone words that are long enough.</p><h2>War</h2><p>The <a href="/wiki/War_of_X">war</a> was long and it was hard &amp; cold.</p>'
    lead, war = E.sections_text(html)
    assert (lead["title"], war["title"]) == ("(lead)", "War")
    for s in (lead, war):
        for p in s["paras"]:
            for link in p["links"]:
                assert p["text"][link["at"] :].lower().startswith(link["target"].split("_")[0].split()[0].lower())
    assert E.sections_text(None)[0]["paras"] == [] and E.sections_text("<p>open <b>never closed and long enough to stay")[0]["paras"]


def test_shortest_order_and_packing():
    angles = np.linspace(0, 1.5, 12)
    mixed = np.random.default_rng(1).permutation(12)
    v = np.column_stack([np.cos(angles), np.sin(angles)])[mixed]
    for n in (6, 12):
        keep = [i for i in range(12) if mixed[i] < n]
        order = C.shortest_order(v[keep], left=np.array([1.0, 0.0]))
        assert [int(mixed[keep[i]]) for i in order] == list(range(n))
    card = lambda i, a, b, h=1, line=None: {"id": i, "left": a, "right": b, "height": h, "line": line}
    placed = L.pack_cards([card(1, 0, 10), card(2, 5, 15, 2), card(3, 0, 30, 1, (0, 30)), card(4, 40, 50)], 2, [card(5, 0, 5), card(6, 20, 30)])
    assert placed == {1: 0, 2: 1, 3: 3, 4: 0, 5: 1, 6: 0}


def test_patience_waits_and_gives_up():
    from almanack.sources.web import Patience, paged

    waits, answers = [], iter([(429, None), (500, None), (200, "x")])
    assert Patience(sleep=waits.append).get(lambda u: next(answers), "u") == "x" and waits[0] == 30.0
    assert Patience(tries=3, sleep=waits.append).get(lambda u: (500, None), "u") is None
    assert list(paged(lambda u: (200, {"continue": 1}), str, Patience(sleep=waits.append), most=5)) == [{"continue": 1}] * 5
