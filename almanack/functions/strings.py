"""String functions as column expressions; Python is used only where a scanner is needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words that a keyword search leaves out.
SEARCH_STOP = (
    "a an and are as at be by for from has have he her his in is it its of on or that the their this to was were which who "
    "with what when where how did does do about into than then there these those after before during between over under"
).split()
# Words that the stored index leaves out.
INDEX_STOP = (
    "a an and are as at be by for from has have in is it its of on or that the to was were which with his her their he she "
    "they this these those not but also into than then there after before over under who whom whose de la le el di da von van der"
).split()
# Words that two titles may share by chance, and capitalised words that are no names.
TITLE_STOP = "the and of in at on for with from into his her its their by to a an as is was are were first second after".split()
NOT_NAMES = "Battle Death Birth Siege Treaty War King Queen Emperor Empire Execution Capital".split()
# Letters that decomposition leaves whole, and how they are written in ASCII.
TRANSLITERATED = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe"}


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose decomposition is one ASCII letter plus marks, as a translate() pair, and the longer ones."""
    plain, longer = {}, []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d.isascii() and d != c:
            plain[c] = d
    for c, d in TRANSLITERATED.items():
        if len(d) == 1:
            plain[c] = d
        else:
            longer.append((c, d))
    return "".join(plain), "".join(plain.values()), longer


_FROM, _TO, _LONGER = _folding()


def fold(c: Column, transliterate: bool = True) -> Column:
    """Lower-cased without accents, inside the JVM: translate() over a table made from Unicode data."""
    c = F.translate(F.lower(c), _FROM, _TO)
    if transliterate:
        for a, b in _LONGER:
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[̀-ͯ]", "")


def slugify(c: Column, limit: int = 72) -> Column:
    s = F.regexp_replace(fold(c), r"['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    s = F.regexp_replace(F.left(s, F.lit(limit)), r"-+\z", "")
    return F.when(s == "", "x").otherwise(s)


def entry_id(dataset: Column, title: Column, year: Column) -> Column:
    """dataset:slug:year, `nd` without a year, `44bc` before year 0."""
    text = F.when(year.isNull(), "nd").when(year < 0, F.concat(F.abs(year).cast("string"), F.lit("bc"))).otherwise(year.cast("string"))
    return F.concat_ws(":", dataset, slugify(title), text)


def dedupe_lower(c: Column) -> Column:
    """Parts between | / ; in lower case, trimmed, without empty ones and repeats."""
    parts = F.transform(F.split(c, r"[|/;]"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def stem(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(F.left(w, n - 3), F.lit("y")))
        .when((n > 3) & w.endswith("s") & ~w.rlike(r"(ss|us|is)\z"), F.left(w, n - 1))
        .otherwise(w)
    )


def tokenize(c: Column) -> Column:
    """Search terms: folded, longer than a letter or with a digit, without stop words, stemmed."""
    parts = F.split(fold(c), r"[^a-z0-9]+")
    kept = F.filter(parts, lambda w: ((F.length(w) > 1) | w.rlike("[0-9]")) & ~w.isin(*SEARCH_STOP))
    return F.transform(kept, stem)


def index_tokens(c: Column) -> Column:
    """Terms of the inverted index: two letters or more, no transliteration."""
    parts = F.split(fold(c, transliterate=False), r"[^a-z0-9]+")
    return F.transform(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*INDEX_STOP)), stem)


def shard_of(token: Column) -> Column:
    return F.when(token.rlike("^[a-z0-9]{2}"), F.left(token, F.lit(2))).otherwise(F.lit("__"))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more, without those that titles share by chance, plurals folded."""
    parts = F.filter(F.split(fold(c), r"[^a-z0-9_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP))
    plural = lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(parts, plural))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger number of words, parentheses left out."""
    words = lambda c: content_words(F.regexp_replace(c, r"\([^)]*\)", ""))
    a, b = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def proper_names(c: Column) -> Column:
    """Distinct capitalised words of three letters or more that can be names."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*NOT_NAMES) & ~F.lower(w).isin(*TITLE_STOP)))


def clip(c: Column, n: int) -> Column:
    """At most n characters, cut before a word."""
    return F.when(F.length(c) <= n, c).otherwise(F.regexp_replace(F.left(c, F.lit(n)), r"\s+\S*\z", ""))


def first_sentence(c: Column, n: int = 160) -> Column:
    one = F.split(F.trim(c), r"(?<=[.!?])\s+(?=[A-Z“\"(])", 2)[0]
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(n)), r"\s+\S*\z", ""), F.lit("…")))


def summary(c: Column, n: int) -> Column:
    """Up to n characters, ended at the last sentence end beyond 80 characters, else at a word."""
    head = F.left(c, F.lit(n))
    back = F.reverse(head)
    ends = F.least(*(F.when(F.locate(p, back) > 0, F.locate(p, back)).otherwise(F.lit(n + 1)) for p in (" .", " ?")))
    at = F.length(head) - ends  # characters up to and with the mark
    return F.when(F.length(c) <= n, c).when(at > 80, F.left(head, at)).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit("…")))


def unescape_excerpt(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 code units, as an unsigned number; null for null."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 0x01000193) % (1 << 32))



def answer_matches(guess: Column, answer: Column) -> Column:
    """Whether a typed answer will do: equal; all words of the answer; or one of its words of four letters or more."""
    words = lambda c: F.filter(F.split(fold(c), r"[^a-z0-9]+"), lambda w: w != "")
    one = lambda a: (F.size(words(guess)) > 0) & (
        (F.array_join(words(guess), " ") == F.array_join(words(a), " "))
        | ((F.size(words(a)) > 0) & (F.size(F.array_except(words(a), words(guess))) == 0))
        | ((F.size(words(guess)) == 1) & (F.length(words(guess)[0]) >= 4) & F.array_contains(words(a), words(guess)[0]))
    )
    return F.exists(F.split(answer, r"\s/\s"), one)
