"""Signed years and spans of years: parsing, labels, windows and tolerances."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

YEAR_NOW = 2026
#: Ages from here on fit no long and are no dates.
LARGEST = 2.0**62
_SCALE = {"ga": 10**9, "ma": 10**6, "ka": 10**3, "kya": 10**3, "mya": 10**6, "gya": 10**9, "billion": 10**9, "million": 10**6, "thousand": 10**3, "": 1}
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_AGO = re.compile(rf"({_NUMBER})\s*(?:(Ga|Ma|ka|kya|mya|gya)\b|(billion|million|thousand)?\s*(years ago|BP\b)?)", re.I)
_DASH = r"\s*(?:[-–—]|\bto\b|\band\b)\s*"


def parse_era_year(c: Column) -> Column:
    """The first whole number of up to 12 digits, negative before the era."""
    text = F.regexp_replace(c, r"(?<=\d),(?=\d{3})", "")
    n = F.regexp_extract(text, r"(-?\d{1,12})", 1)
    value = F.when(n != "", n.cast("long"))
    return F.when(text.rlike(r"(?i)\bB\.?C") & (value > 0), -value).otherwise(value)


def is_circa(c: Column) -> Column:
    return c.rlike(r"(?i)(^|\W)(c|ca|circa|fl)(\.|\s|$)|[~?]")


def _ago(text: str) -> tuple[int | None, int | None] | None:
    """Spans told as time before now: units on either side; one without a unit takes the other's. Of an age that no long holds, two nulls."""
    if not re.search(r"\b(Ga|Ma|ka|kya|mya|gya|BP)\b|years ago", text, re.I) or re.search(r"\b(BC|BCE|AD|CE)\b", text):
        return None
    text = re.sub(rf"±\s*{_NUMBER}(?:\s*(?:Ga|Ma|ka))?", lambda m: re.sub(r"[\d.,±\s]+", " ", m[0]), text)
    found = []
    for part in re.split(_DASH, text):
        m = re.search(rf"({_NUMBER})", part)
        if not m:
            continue
        unit = re.search(r"\b(Ga|Ma|ka|kya|mya|gya|billion|million|thousand)\b", part, re.I)
        bp = bool(re.search(r"\bBP\b", part))
        plain = bool(re.search(r"years ago", part)) or bp
        found.append([float(m[1].replace(",", "")), unit[1].lower() if unit else None, plain, bp])
    if not found:
        return None
    last = found[-1]
    for f in found[:-1]:
        if f[1] is None and not f[2]:
            if last[1] and not 0.01 <= f[0] / max(last[0], 1e-9) <= 100:
                return None
            f[1], f[2], f[3] = last[1], last[2], last[3]
    years = []
    for value, unit, _, bp in found[:2]:
        if not value * _SCALE[unit or ""] < LARGEST:
            return None, None
        age = round(value * _SCALE[unit or ""])
        years.append(1950 - age if bp and age < 100_000 else -age)
    return years[0], years[-1]


def parse_years_text(text: str | None, now: int = YEAR_NOW) -> tuple[int, int] | None:
    """(start, end) of a year or a range; a range told backwards stays so."""
    if not text:
        return None
    if (span := _ago(text)) is not None:
        return None if span[0] is None else span
    text = re.sub(r"(?<=\d),(?=\d{3})", "", text)
    bc = lambda s: bool(re.search(r"\bB\.?C", s, re.I))
    ad = lambda s: bool(re.search(r"\bA\.?D|\bC\.?E", s, re.I)) and not bc(s)
    parts = re.split(_DASH, re.sub(r"^\s*between\s+", "", text.strip(), flags=re.I), maxsplit=1)
    numbers = [re.search(r"\d{1,12}", p) for p in parts]
    if len(parts) == 2 and not parts[0].strip() and numbers[1]:  # a sign, not a range
        return (-int(numbers[1][0]),) * 2
    if numbers[0] is None:
        return None
    start = int(numbers[0][0])
    if len(parts) == 1 or (numbers[1] is None and not re.search(r"present|now|today", parts[1], re.I)):
        start = -start if bc(text) else start
        return start, start
    if numbers[1] is None:
        return (-start if bc(parts[0]) else start), now
    end = int(numbers[1][0])
    if bc(parts[1]):
        return -start, -end
    if bc(parts[0]):
        return -start, end
    if ad(parts[1]) and start > end:
        return -start, end  # the range straddles the era
    if end < start and len(numbers[1][0]) < len(numbers[0][0]) and len(numbers[1][0]) == 2:
        end += start // 100 * 100 if end >= start % 100 else (start // 100 + 1) * 100
    return start, end


@F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
def parse_years(texts: pd.Series) -> pd.DataFrame:
    found = [parse_years_text(t) or (None, None) for t in texts]
    return pd.DataFrame({"start": pd.array([a for a, _ in found], "Int64"), "end": pd.array([b for _, b in found], "Int64")})


# Units of measure and durations; a number before one is no year.
UNITS = (
    r"k?m|mi|ft|yd|nmi|ha|kg|lb|t|%|°|km2|m2|km²|m²|kilometres?|kilometers?|metres?|meters?|miles?|feet|foot|yards?|inches|"
    r"acres?|hectares?|square|cubic|tonnes?|tons?|pounds?|kilograms?|degrees?|percent|per\s+cent|people|inhabitants|residents|households|species|"
    r"members|seats|votes|pages|words|lines|units|copies|episodes|million|billion|trillion|thousand|hundred|"
    r"years?|months?|weeks?|days?|hours?|minutes?|seconds?|decades?|centuries|century"
)
_DEEP = re.compile(rf"({_NUMBER}\s*(?:(?:billion|million|thousand)\s+years ago|Ga\b|Ma\b|ka\b)|{_NUMBER}\s+years ago)")
_CUE = r"(?:in|since|by|from|until|till|during|circa|c\.|about|around|of)"
_PLAIN = r"(?:\d{1,4}\s*(?:BCE|BC|AD|CE)\b|\d{3,4})"
_SPAN = rf"{_PLAIN}(?:{_DASH}\d{{1,4}}\s*(?:BCE|BC|AD|CE)\b|{_DASH}\d{{2,4}})?"


_COUNTED = re.compile(rf"(?:[.,]\d|\s*(?:(?:{UNITS})\b|[%°]))", re.I)
_IN_NUMBER = frozenset("0123456789.,")
_ANCHORED = re.compile(rf"\s*({_DEEP.pattern}|(?:c\.\s*|ca\.\s*)?(?:\d{{3,4}}s|{_SPAN})(?=[\s,:.–-]|$))")


def _forward(text: str, at: int, to: int) -> tuple[int, int]:
    """A range that runs backwards is a misread: its first year alone is the date."""
    span = parse_years_text(text[at:to])
    if span and span[1] < span[0] and (m := re.search(_DASH, text[at:to])):
        return at, at + len(text[at : at + m.start()].rstrip())
    return at, to


def find_date_span(text: str | None, mode: str = "default") -> tuple[int, int] | None:
    """Where the date in a sentence begins and ends, by trust: `anchored` at its very start, `default` with a cue before it,
    `loose` any plausible year. A number of things, a duration or a fraction is none."""
    if not text:
        return None
    ok = lambda m, g=0: not _COUNTED.match(text, m.end(g)) and text[m.start(g) - 1 : m.start(g)] not in _IN_NUMBER
    if mode == "anchored":
        m = _ANCHORED.match(text)
        return _forward(text, *m.span(1)) if m and (_DEEP.fullmatch(m[1]) or ok(m, 1)) else None
    if (m := _DEEP.search(text)) and not re.search(rf"(?:over|for|approximately)\s+{_NUMBER}\s*(?:billion|million|thousand)?\s*years(?!\s+ago)", text):
        return m.span()
    if (m := re.search(rf"\b{_CUE}\s+(?:the\s+)?({_PLAIN})\b(?![\d,]*\d)", text)) and ok(m, 1):
        return m.span(1)
    if mode == "loose":
        if (m := re.search(rf"\bbetween\s+({_PLAIN}\s+and\s+{_PLAIN})", text)) and ok(m, 1):
            return _forward(text, *m.span(1))
        for m in re.finditer(r"\b(1\d{3}|20\d{2})(s?)\b", text):
            if ok(m):
                return m.span()
    return None


def find_date_text(text: str | None, mode: str = "default") -> str | None:
    """The date that find_date_span finds."""
    span = find_date_span(text, mode)
    return text[span[0] : span[1]] if span else None


def text_dates(text: str | None) -> list[tuple[str, int, int]] | None:
    """(date, start, end) of every sentence of a whole text that has a plausible date; null text: None."""
    if text is None:
        return None
    found = [find_date_text(s, "loose") for s in re.split(r"\n+|(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])", text)]
    return [(f, *span) for f in found if f and (span := parse_years_text(f))]


def year_label(y: Column) -> Column:
    """1914; 44 BC; 66 million years ago (three significant figures)."""
    age = -y.cast("double")

    def deep(scale: float, name: str) -> Column:
        v = age / scale
        digits = F.when(v >= 100, F.format_string("%.0f", F.round(v))).when(v >= 10, F.format_string("%.1f", F.round(v, 1))).otherwise(F.format_string("%.2f", F.round(v, 2)))
        return F.concat(F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(f" {name} years ago"))

    return (
        F.when(y <= -1_000_000_000, deep(1e9, "billion"))
        .when(y <= -1_000_000, deep(1e6, "million"))
        .when(y <= -100_000, F.concat(F.format_number(-y, 0), F.lit(" years ago")))
        .when(y < 0, F.concat((-y).cast("string"), F.lit(" BC")))
        .otherwise(y.cast("string"))
    )


def overlaps(start: Column, end: Column, lo: Column | int, hi: Column | int, open_ended: Column | None = None, now: int = YEAR_NOW) -> Column:
    """Whether [start, end] meets [lo, hi]; no end: a point; open-ended: up to now."""
    last = F.coalesce(end, start)
    if open_ended is not None:
        last = F.when(open_ended, F.lit(now)).otherwise(last)
    return (start <= hi) & (last >= lo)


def anchor_year(start: Column, end: Column, person: Column) -> Column:
    """A person stands at 0.6 of the life, halves rounded up; all else at its start."""
    return F.when(person & end.isNotNull(), F.floor(start + (end - start) * 0.6 + 0.5)).otherwise(start).cast("long")


def meanwhile_window(year: Column, now: int = YEAR_NOW) -> Column:
    """Years to either side that count as the same time: 3.5 % of the age, at least 4."""
    return F.greatest(F.lit(4), F.floor((now - year) * 0.035 + 0.5)).cast("long")


def year_tolerance(y: Column) -> Column:
    return F.when(F.abs(y) < 3000, F.lit(3.0)).otherwise(F.greatest(F.lit(3.0), F.abs(y) * 0.02))


def typed_years(c: Column) -> Column:
    """Signed whole numbers; a hyphen after a digit is no sign."""
    bc = c.rlike(r"(?i)\bB\.?C")
    found = F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"((?<!\d)-?\d+)"), F.lit(1))
    return F.transform(found, lambda x: F.when(bc & (x.cast("long") > 0), -x.cast("long")).otherwise(x.cast("long")))


def time_range(year: Column, precision: Column) -> Column:
    """[lo, hi] that a year of precision 9 (year), 8 (decade), 7 (century) or 6 (millennium) stands for."""
    step = F.when(precision == 8, 10).when(precision == 7, 100).when(precision == 6, 1000).otherwise(1)
    decade = F.floor(year / step) * step
    upper = F.ceil(F.abs(year) / step) * step
    lo = F.when(step == 1, year).when((step == 10) & (year > 0), decade).when(year > 0, upper - step + 1).otherwise(-upper)
    hi = F.when(step == 1, year).when((step == 10) & (year > 0), decade + 9).when(year > 0, upper).otherwise(-upper + step - 1)
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def tick_step(px_per_year: Column, least_px: float = 70) -> Column:
    """The smallest of 1, 2, 5 times powers of ten whose ticks are least_px apart."""
    need = F.lit(float(least_px)) / px_per_year
    base = F.pow(F.lit(10.0), F.floor(F.log10(need)))
    step = F.when(base >= need, base).when(2 * base >= need, 2 * base).when(5 * base >= need, 5 * base).otherwise(10 * base)
    return F.greatest(F.lit(1.0), step)
