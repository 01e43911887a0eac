"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from almanack.llm.session import write

#: Buckets that word unigrams and bigrams are hashed to; what reaches the driver is one row for each.
BUCKETS = 8192
#: Share of the trusted documents that the threshold lets go.
TRUSTED_LOSS = 0.002

#: Intervals that a column's range is cut into in search of a quantile, and rows that the driver may sort.
INTERVALS, SORTED_ROWS = 1024, 10_000

_SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _repeat_words(words: Column, n: int = 5) -> Column:
    """Words in n-word windows that occur twice or more. Window hashes are sorted with their
    places only in texts where some hash repeats."""

    def windows(h: Column) -> Column:
        places = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))

    def total(found: Column) -> Column:
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(found, start, lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(n), i - a["last"])).alias("sum")), lambda a: a["sum"])

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, lambda s: total(F.filter(places(s), lambda i: i.isNotNull()))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), counted)).cast("long")


def _grams(words: Column, buckets: int) -> Column:
    """Buckets of the lower-cased words and of their adjacent pairs."""

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        two = F.transform(h, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(buckets)).cast("int")))
        return F.concat(one, F.filter(two, lambda x: x.isNotNull()))

    return _let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), both)


def _mean_ratio(words: Column, ratios: list[float]) -> Column:
    """Mean ratio of a text's n-grams; 0 without any."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    sums = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size(g), F.lit(1))
    return _let(_grams(words, len(ratios)), sums)


def statistics(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, the base statistics and the score of every whole text, split into words once; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _duplicate_lines(text).alias("n_dup_lines"),
        _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"), _mean_ratio(w, ratios).alias("score"))).alias("w"),
    )
    return base.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score").withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """log p(bucket | target) / p(bucket | corpus), from the bucket counts of all documents."""
    # the build side has ids only; null ids are never trusted and stay where they are
    known = docs.where("doc_id IS NOT NULL").join(trusted.withColumn("t", F.lit(1)).hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("t", F.lit(0)).alias("t"))
    marked = known.unionByName(docs.where("doc_id IS NULL").select("text", F.lit(0).alias("t")))
    marked = marked.select("t", F.explode(_grams(_words(F.coalesce(F.col("text"), F.lit(""))), buckets)).alias("b"))
    target, raw = [0.0] * buckets, [0.0] * buckets
    for r in marked.groupBy("b").agg(F.sum("t").alias("target"), F.count("*").alias("raw")).collect():
        target[r.b], raw[r.b] = float(r.target), float(r.raw)
    n_target, n_raw = sum(target), sum(raw)
    # one pseudo-count a bucket, spread as the corpus is, keeps a small target near the corpus
    prior = [(r + 1) / (n_raw + buckets) for r in raw]
    return [math.log((t + buckets * p) / (n_target + buckets)) - math.log(p) for t, p in zip(target, prior)]


def _quantile(rows: DataFrame, share: float) -> float | None:
    """The exact quantile of column x, between neighbours in proportion, by counts over ever smaller
    intervals: the driver gets INTERVALS or SORTED_ROWS rows at once, and no task gets all. None without rows."""
    ends = rows.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not ends.n:
        return None

    def value(rank: int) -> float:
        n, lo, hi = ends.n, ends.lo, ends.hi
        while lo < hi:
            inside = rows.where(F.col("x").between(lo, hi))
            if n <= SORTED_ROWS:
                return sorted(r.x for r in inside.collect())[rank]
            part = F.least(F.floor((F.col("x") - lo) / F.lit(hi - lo) * INTERVALS), F.lit(INTERVALS - 1)).alias("part")
            for r in sorted(inside.groupBy(part).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
                if rank < r.n:
                    n, lo, hi = r.n, r.lo, r.hi
                    break
                rank -= r.n
        return lo

    place = (ends.n - 1) * share
    low = value(math.floor(place))
    return low if place == math.floor(place) else low + (place - math.floor(place)) * (value(math.ceil(place)) - low)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, loss: float = TRUSTED_LOSS) -> DataFrame:
    """Statistics, base rules and verdict of every document.

    Target: the multinomial of hashed word unigrams and bigrams of all documents labelled quality 1.
    Raw: that of all documents. A document's score is the mean log ratio of its n-grams; it is kept
    if the score is not under the `loss` quantile of all trusted documents' scores, lowered by three
    standard errors, so that short texts aren't judged by chance, and it passes the base rules. Only
    DataFrame functions are used; texts are shuffled once, to be joined with the trusted ids, and
    the driver gets one row a bucket. Statistics and scores are written to the shared folder, where
    the quantile is read from them.

    Null text has no words and fails. Without any trusted document the ratios are 0 and the base
    rules decide. Null ids are never trusted; equal rows each get their row; several labels of one
    id count once; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    ratios = _ratios(docs, trusted, buckets)
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    # spread of one n-gram's ratio over the corpus' buckets
    spread = math.sqrt(sum(x * x for x in ratios) / len(ratios))
    eased = F.col("score") + 3 * spread / F.sqrt(grams)
    scored = write(statistics(docs, ratios))
    known = scored.where("n_words >= 10").select("doc_id", eased.alias("x")).join(trusted.hint("shuffle_hash"), "doc_id")
    limit = _quantile(write(known.select("x")), loss)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (eased >= F.lit(limit if limit is not None else -1e300))).alias("kept"), "score",
    )
