"""Dated events out of pages: lines with what their headings carry, trusted tiers before loose ones, one telling each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from almanack.functions import text as X
from almanack.functions.dates import find_date_span, is_circa, parse_years_text
from almanack.operators.tables import mine_tables
from almanack.session import keep

# Sections that are no content; the age of the Earth in years; words of a date told as time before now.
SKIP_SECTION = r"(?i)^(?:see also|references?|further reading|external links?|notes?|bibliography|sources?|footnotes?|citations?|gallery)$"
EARTH_AGE = 4_600_000_000
TOLD_AGO = r"(?i)ago|BP|\b[GMk](?:a|yr)\b|billion|million|thousand|\d0s\b"
HAS_ERA = r"(?i)\b(?:BCE?|AD|CE|B\.C|A\.D)\b|ago|BP|\b(?:Ga|Ma|ka)\b|million|billion"
BEFORE_ERA = r"(?i)\bB\.?C"
#: Tiers in the order in which they are trusted.
TIERS = ("mined-table", "mined-line", "mined-prose")
#: Letters that an event needs if its date governs its text, and if it stands within a sentence.
DATED_LEAST, PROSE_LEAST, MOST, HEADING_SPAN = 12, 40, 700, 25

_DATE = T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("nth", T.IntegerType())])


def dates_in(c: Column, mode: str, *more: Column) -> Column:
    """struct (text, at, start, end, nth) of the date in the first of each row's texts that has one, all null without one; texts without a digit
    are passed over."""

    def one(*said: str | None) -> tuple:
        for i, t in enumerate(said):
            if t and any(map(str.isdigit, t)) and (found := find_date_span(t, mode)) is not None and (span := parse_years_text(t[found[0] : found[1]])):
                return t[found[0] : found[1]], found[0], *span, i
        return (None,) * 5

    @F.pandas_udf(_DATE)
    def dates(*texts: pd.Series) -> pd.DataFrame:
        text, at, start, end, nth = zip(*map(one, *texts)) if len(texts[0]) else ((),) * 5
        return pd.DataFrame({"text": pd.array(text, "string"), "at": pd.array(at, "Int32"), "start": pd.array(start, "Int64"), "end": pd.array(end, "Int64"), "nth": pd.array(nth, "Int32")})

    return dates(c, *more)


def tidy_line(c: Column) -> Column:
    """Without footnote numbers and empty brackets, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[\d+\]", ""), r"\(\s*\)", ""), r"\s{2,}", " "))


def page_body(html: Column) -> Column:
    """A page's text, a line for each block, headings as == lines ==."""
    return X.decode_entities(_clean(F.regexp_replace(html, r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", "<p>== $2 ==</p>")))


def _clean(html: Column) -> Column:
    from almanack.sources.text import clean_html

    return clean_html(html)


def page_lines(pages: DataFrame) -> DataFrame:
    """(page, title, n, line, section, carried): the lines of pages (page, title, body), each with the heading
    above it and, if that heading is nothing but a year or a short span, the heading as the date it carries.

    Heading lines, empty lines and lines of apparatus sections are left out. The state is a running
    last value over the lines of a page, in order.
    """
    lines = pages.select("page", "title", F.posexplode(F.split("body", "\n")).alias("n", "raw")).withColumn("line", tidy_line("raw")).where("line <> ''")
    head = F.regexp_extract("line", r"^(=+)\s*(.*?)\s*\1$", 2)
    is_head = F.col("line").rlike(r"^(=+)\s*(.*?)\s*\1$")
    lines = lines.withColumn("heading", F.when(is_head, head)).withColumn("d", dates_in(F.col("heading"), "anchored"))
    after = F.regexp_replace(F.expr("substring(heading, d.at + length(d.text) + 1)"), r"^[\s.,:;–—-]+", "")
    dated = F.col("d.text").isNotNull() & (after == "") & ((F.col("d.end") - F.col("d.start")) <= HEADING_SPAN)
    state = F.when(F.col("heading").isNotNull(), F.struct(F.col("heading").alias("section"), F.when(dated, F.col("heading")).alias("carried")))
    so_far = Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("_s", F.last(state, ignorenulls=True).over(so_far)).where("heading IS NULL")
    return held.select("page", "title", "n", "line", F.coalesce("_s.section", F.lit("")).alias("section"), F.col("_s.carried").alias("carried")).where(~F.col("section").rlike(SKIP_SECTION))


def ambiguous_separator(said: Column) -> Column:
    """Whether a point may be one of thousands: three digits after it, and the number without it isn't older than the Earth."""
    whole, part = F.regexp_extract(said, r"(?<!\d)([1-9]\d*)\.(\d{3})(?!\d)", 1), F.regexp_extract(said, r"(?<!\d)([1-9]\d*)\.(\d{3})(?!\d)", 2)
    unit = F.when(said.rlike(r"(?i)\bGa\b|billion"), F.lit(10**9)).when(said.rlike(r"(?i)\bMa\b|million"), F.lit(10**6)).when(said.rlike(r"(?i)\bka\b|thousand"), F.lit(10**3)).otherwise(F.lit(1))
    return (part != "") & (F.concat(whole, part).try_cast("double") * unit <= EARTH_AGE)


def candidates(lines: DataFrame) -> DataFrame:
    """Dated chunks of page_lines: a line that opens with its date, or takes its heading's, else each dated sentence.

    (page, title, section, n, m, tier, date, chunk, body): m is the sentence of its line; body is the chunk
    without a leading date.
    """
    lent = F.when(F.col("carried").isNotNull(), F.concat_ws(" – ", "carried", "line"))
    own = lines.withColumn("lent", lent).withColumn("own", dates_in(F.col("line"), "anchored", F.col("lent")))
    strict = F.col("own.text").isNotNull()
    # one pass: what has a date of its own is one chunk, the rest is cut into sentences, and only those are asked again
    chunk = F.when(strict, F.array(F.when(F.col("own.nth") == 1, F.col("lent")).otherwise(F.col("line")))).otherwise(X.timeline_sentences(F.when(~strict, F.col("line"))))
    said = own.select("page", "title", "section", "n", "own", F.posexplode(chunk).alias("m", "chunk"))
    said = said.withColumn("loose", dates_in(F.when(~strict, F.col("chunk")), "loose"))
    date = F.when(strict, F.col("own")).otherwise(F.col("loose"))  # unnested, as a filter would ask for dates twice
    both = said.select("page", "title", "section", "n", "m", F.when(strict, 1).otherwise(2).alias("tier"), F.explode(F.filter(F.array(date), lambda d: d["text"].isNotNull())).alias("date"), "chunk")
    before, after = F.expr("left(chunk, date.at)"), F.expr("substring(chunk, date.at + length(date.text) + 1)")
    leads = tidy_line(before) == ""
    return both.withColumn("body", tidy_line(F.when(leads, F.concat(before, after)).otherwise(F.col("chunk")))).withColumn("least", F.when(leads, DATED_LEAST).otherwise(PROSE_LEAST))


def mine_events(pages: DataFrame, limit: int | None = None, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of pages (page, title, body), and what was refused with its reason.

    tables (page, start, end, text), rows of dated tables, come before lines, and lines before sentences: per
    page an event (start, title in any case) is told once, by the first tier that has it. All events come out; a
    caller that wants only the first of each page gives a `limit`, which each tier has for itself, so that loose ones never crowd out trusted ones. A bare year
    under a heading, or on a page, of the years before the era is one of them. A span that runs backwards and
    a number whose point may be one of thousands are refused. Events: page, tier, start, end, year_text, kind,
    circa, name, excerpt, section. Null bodies have none; an empty table gives none.
    """
    found = candidates(page_lines(pages.where("body IS NOT NULL")))
    found = found.withColumn("era", F.coalesce(F.col("section").rlike(BEFORE_ERA), F.lit(False)) | F.coalesce(F.col("title").rlike(BEFORE_ERA), F.lit(False)))
    found = found.withColumn("turned", F.col("era") & (F.col("date.start") > 0) & ~F.col("date.text").rlike(HAS_ERA))
    rows = found.select(
        "page", "tier", "n", "m", "section", F.col("chunk").alias("excerpt"), "body", "least",
        F.when(F.col("turned"), F.concat("date.text", F.lit(" BC"))).otherwise(F.col("date.text")).alias("year_text"),
        F.when(F.col("turned"), -F.col("date.start")).otherwise(F.col("date.start")).alias("start"),
        F.when(F.col("turned"), -F.col("date.end")).otherwise(F.col("date.end")).alias("end"),
    )
    if tables is not None:
        text = tidy_line(F.col("text"))
        rows = rows.unionByName(tables.select("page", F.lit(0).alias("tier"), F.lit(0).alias("n"), F.lit(0).alias("m"), F.lit("").alias("section"), text.alias("excerpt"), text.alias("body"), F.lit(DATED_LEAST).alias("least"), F.lit("").alias("year_text"), "start", "end"))
    rows = rows.withColumn("name", X.title_from(F.col("body"))).where((F.length("name") >= 3) & (F.length(F.regexp_replace("body", X.DANGLING, "")) >= F.col("least")) & (F.length("excerpt") <= MOST))
    reason = F.when(ambiguous_separator(F.col("year_text")), "ambiguous separator").when(F.col("end") < F.col("start"), "backwards span")
    rows = keep(rows.withColumn("reason", reason))  # texts are read once, for both tiers and what is refused
    refused = rows.where("reason IS NOT NULL").select("page", "name", "year_text", "reason")
    kept = rows.where("reason IS NULL").withColumn("key", F.lower("name"))

    order = ["n", "m", "excerpt", "end"]
    once = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("page", "start", "key").orderBy("tier", *order))).where("_r = 1").drop("_r")
    first = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("page").orderBy("tier", *order))).where(F.col("_r") <= limit).drop("_r")
    if limit is None:
        told = once(kept)
    else:
        strict = first(once(kept.where("tier < 2")))
        told = strict.unionByName(first(once(kept.where("tier = 2")).join(strict.select("page", "start", "key"), ["page", "start", "key"], "left_anti")))
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    events = told.select(
        "page", tier.alias("tier"), "start", "end", "year_text", F.when(F.col("end") != F.col("start"), "span").otherwise("point").alias("kind"),
        (is_circa(F.col("year_text")) | F.col("year_text").rlike(TOLD_AGO)).alias("circa"), "name", "excerpt", "section",
    )
    return events, refused


def told_once(events: DataFrame) -> DataFrame:
    """events of many pages, each (start, name in any case) once: the most trusted tier, then the first page.

    The first rows are taken in every task before rows are shuffled, so an event that all pages tell is no hot key.
    """
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    w = Window.partitionBy("start", F.lower("name")).orderBy(rank, "page", "excerpt", "end")
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page, start, end, text) of the dated tables of pages (page, html)."""
    return mine_tables(pages.select(F.col("page").alias("page_id"), "html")).withColumnRenamed("page_id", "page")
