"""A small filter language over entries, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from almanack.functions.dates import overlaps

_KEYS = {"ds": "datasets", "topic": "topics", "subject": "subjects", "region": "regions", "has": "has"}
_BETWEEN = ("-", "–")


@dataclass
class Filter:
    """A parsed query; empty means no filter."""

    text: list[str] = field(default_factory=list)
    years: tuple[int, int] | None = None
    datasets: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    has: list[str] = field(default_factory=list)
    facets: dict[str, list[str]] = field(default_factory=dict)


def _year(s: str) -> int | None:
    """A signed year of up to four digits."""
    digits = s.removeprefix("-")
    return int(s) if digits.isdecimal() and digits.isascii() and len(digits) <= 4 else None


def _years(word: str) -> tuple[int, int] | None:
    """The range that a word such as 1200-1250, -300–-200 or 5to9 is; a hyphen in front is a sign."""
    cuts = [(i, len(mark)) for mark in (*_BETWEEN, "to") for i in range(1, len(word)) if word.startswith(mark, i)]
    for i, n in sorted(cuts):
        ends = _year(word[:i]), _year(word[i + n :])
        if None not in ends:
            return min(ends), max(ends)
    return None


def parse(raw: str) -> Filter:
    """Free words, a range of years, and ds: topic: subject: region: has: with _ for a space."""
    out, words = Filter(), (raw or "").lower().split()
    for i in range(1, len(words) - 1):  # a range in three words
        if words[i] in (*_BETWEEN, "to") and None not in (_year(words[i - 1]), _year(words[i + 1])):
            words[i - 1 : i + 2] = ["", words[i - 1] + "to" + words[i + 1], ""]
    for word in filter(None, words):
        key, colon, value = word.partition(":")
        if (years := _years(word)) is not None:
            out.years = years
        elif value and key in _KEYS:
            getattr(out, _KEYS[key]).append(value.replace("_", " ") if key in ("topic", "subject", "region") else value)
        else:
            out.text.append(word)
    return out


def haystack(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def _found(part: str, c: Column) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(part)), F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


#: How each clause of a filter reads the columns of an entry.
CLAUSES: dict[str, Callable[[object], Column]] = {
    "has": lambda flags: _all([F.coalesce(F.col(flag).cast("string") != "", F.lit(False)) for flag in flags]),
    "topics": lambda parts: _all([F.coalesce(F.exists("topics", lambda t: _found(p, t)), F.lit(False)) for p in parts]),
    "regions": lambda parts: _all([_found(p, F.col("region")) for p in parts]),
    "subjects": lambda parts: _all([_found(p, F.col("subject")) for p in parts]),
    "datasets": lambda names: F.coalesce(F.lower("dataset").isin(names), F.lit(False)),
    "years": lambda span: F.coalesce(overlaps(F.col("start"), F.col("end"), *span, open_ended=F.col("open_ended")), F.lit(False)),
    "facets": lambda wanted: _all([F.coalesce(F.arrays_overlap(F.element_at("facets", F.lit(k)), F.array(*map(F.lit, v))), F.lit(False)) for k, v in wanted.items()]),
}


def condition(f: Filter, semantic: Column | None = None) -> Column | None:
    """The filter over columns title, subtitle, dataset, subject, region, topics, image, start, end, open_ended and
    facets (a map); None for an empty filter.

    Years overlap; a data set is one of those named; every flag, subject, region and topic holds; all words
    are found in the text, or the row is a semantic match; within a facet any value, across facets all.
    """
    parts = [clause(getattr(f, name)) for name, clause in CLAUSES.items() if getattr(f, name)]
    if f.text:
        text = haystack(F.col("title"), F.col("subtitle"), F.array_join("topics", " "), F.col("dataset"), F.col("subject"), F.col("region"))
        words = _all([F.contains(text, F.lit(w)) for w in f.text])
        parts.append(words if semantic is None else words | F.coalesce(semantic, F.lit(False)))
    return _all(parts) if parts else None


def run(rows: DataFrame, raw: str, semantic: Column | None = None) -> DataFrame:
    test = condition(parse(raw), semantic)
    return rows if test is None else rows.where(test)
