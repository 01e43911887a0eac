"""Operators on points and spans of time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def date_page(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """rows (start, end, kind, person, open_ended) with a column section for each section a row is in: happened, born, died,
    began, ended, ongoing.

    What isn't a span, or has no end or the same end, is a point: it happened, whatever it is of. The end of an
    open-ended span isn't known, so such a span can begin but neither end nor be under way. A person is under way if
    alive and grown: 15 years or more before hi, and no older than 110; another span if shorter than 2,000 years
    and half the page's age.
    """
    s, point = F.col("start"), (F.col("kind") != "span") | F.col("end").isNull() | (F.col("end") == F.col("start"))
    end = F.when(~F.coalesce("open_ended", F.lit(False)), F.col("end"))
    starts, ends = s.between(lo, hi), F.coalesce(end.between(lo, hi), F.lit(False))
    across = ~point & (s < lo) & (end > hi)
    brief = F.when(F.col("person"), (hi - s >= 15) & (end - s <= 110)).otherwise((end - s) < 2000 + 0.5 * abs(lo))
    sections = F.array(
        F.when(point & starts, "happened"),
        F.when(~point & starts, F.when(F.col("person"), "born").otherwise("began")),
        F.when(~point & ends, F.when(F.col("person"), "died").otherwise("ended")),
        F.when(across & brief, "ongoing"),
    )
    return rows.withColumn("section", F.explode(F.filter(sections, lambda x: x.isNotNull())))


def interval_join(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: int, long_buckets: int = 64, on: tuple[str, ...] = ()) -> DataFrame:
    """points with the spans that hold their year, and have equal keys `on`: equi-join on buckets of `width`, then an exact check.

    A span over more than long_buckets buckets is entered in buckets long_buckets times as wide
    instead, and so on, up to four levels, so no span is copied more than that often and no side needs
    to be small.
    """
    ladder = [width * long_buckets**i for i in range(4)]
    n = lambda w: F.floor(F.col(hi) / w) - F.floor(F.col(lo) / w) + 1
    level = F.when(n(ladder[0]) <= long_buckets, 0).when(n(ladder[1]) <= long_buckets, 1).when(n(ladder[2]) <= long_buckets, 2).otherwise(3)
    size = lambda c: F.element_at(F.array(*[F.lit(w) for w in ladder]), c + 1)
    dealt = spans.where(F.col(lo) <= F.col(hi)).withColumn("_l", level)
    dealt = dealt.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / size(F.col("_l"))), F.floor(F.col(hi) / size(F.col("_l"))))))
    keys = F.array(*[F.struct(F.lit(i).alias("_l"), F.floor(F.col(at) / w).alias("_b")) for i, w in enumerate(ladder)])
    probe = points.withColumn("_k", F.explode(keys)).select("*", "_k._l", "_k._b").drop("_k")
    return probe.join(dealt, ["_l", "_b", *on]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_l", "_b")


def band_join(left: DataFrame, right: DataFrame, left_year: str, right_year: str, within: int, *keys: str) -> DataFrame:
    """Pairs at most `within` years apart with equal keys: left rows are entered under each near year."""
    near = left.withColumn("_y", F.explode(F.sequence(F.col(left_year) - within, F.col(left_year) + within)))
    return near.join(right.withColumn("_y", F.col(right_year)), ["_y", *keys]).drop("_y")


def segments(rows: DataFrame, order: list[str], at: str, gap: int, *group: str) -> DataFrame:
    """rows with segment, a number that grows where two neighbours are more than `gap` apart."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def equal_buckets(counts: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """(key, bucket) over distinct keys in order: a bucket is closed once it holds `size` rows; equal keys
    are never split. Only the distinct keys, with their counts, are in the one sequential pass."""

    def run(_, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        bucket, held, out = 0, 0, []
        for c in pdf[n]:
            if held >= size:
                bucket, held = bucket + 1, 0
            out.append(bucket)
            held += c
        return pd.DataFrame({key: pdf[key], "bucket": out})

    kind = dict(counts.dtypes)[key]
    return counts.groupBy(F.lit(0).alias("_g")).applyInPandas(run, f"{key} {kind}, bucket long")


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, other_start: str, other_end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of spans that overlap, each once: the later begins in the earlier, so one start lies in the other span."""
    first = interval_join(right, other_start, left, start, end, width, on=on)
    later = right.withColumn("_after", F.col(other_start) + 1)
    second = interval_join(left, start, later, "_after", other_end, width, on=on).drop("_after")
    return first.unionByName(second)


def era_fence(own: Column, q1: Column, q3: Column) -> Column:
    """struct(lo, hi) of plausible years: about the topic's own span (start, end), wider before than after it, if it
    has one, else 1.5 times the distance of the quartiles beyond them."""
    a, b = own["start"], own["end"]
    has, length = (own.isNotNull() & (b > a)), b - a
    lo = F.when(has, a - F.least(length, F.lit(1000)) - 200).otherwise(q1 - 1.5 * (q3 - q1))
    hi = F.when(has, b + F.least(0.25 * length, F.lit(200)) + 50).otherwise(q3 + 1.5 * (q3 - q1))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def topic_extent(items: DataFrame, share: float = 0.04) -> DataFrame:
    """(topic, from, to) of the items (topic, start, end, person) that a topic shows, without the first and last `share` of them, to two
    significant figures in deep time; people count from 0.6 of their life on, and nothing ends after `now`."""
    from almanack.functions.dates import YEAR_NOW, anchor_year
    from almanack.functions.when import two_figures
    from almanack.operators.ranking import at_ranks

    rows = items.select("topic", anchor_year(F.col("start"), F.col("end"), F.col("person")).alias("a"), F.least(F.lit(YEAR_NOW), F.coalesce("end", "start")).alias("z"))
    cut = F.floor(F.col("n") * share)
    lo, hi = at_ranks(rows, "topic", "a", lo=cut).drop("n"), at_ranks(rows, "topic", "z", hi=F.col("n") - 1 - cut).drop("n")
    return lo.join(hi, "topic").select("topic", two_figures(F.col("lo"), -1).alias("from"), two_figures(F.col("hi"), 1).alias("to"))


def office_of(rows: DataFrame, offices: DataFrame) -> DataFrame:
    """(id, role): for rows (id, person, start, end) the office (person, role, seniority, start, end) of the most points: 100 if its years
    overlap the row's, and its seniority; of equals the first by name."""
    from almanack.functions.dates import overlaps

    o = offices.select("person", "role", "seniority", F.col("start").alias("_s"), F.coalesce("end", "start").alias("_e"))
    dated = F.coalesce(overlaps(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")), F.lit(False))
    score = F.when(dated, 100).otherwise(0) + F.col("seniority")
    return rows.join(o, "person").groupBy("id").agg(F.min_by("role", F.struct(-score, F.col("role"))).alias("role"))
