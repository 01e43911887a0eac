"""Scores, samples and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.session import keep

# How much an entry's type counts.
TYPE_WEIGHT = {"event": 1.0, "person": 0.9, "period": 0.6, "work": 0.75, "place": 0.5, "group": 0.5, "concept": 0.3}


def importance(weight: Column, most: Column, fame: Column, kind: Column, umbrella: Column, lead: Column, headed: Column) -> Column:
    """0.5 of the mentions and 0.35 of fame, more than half of it whatever the type, 0.55 of it for umbrella entries.

    Mentions are the log share of an entry's weight, and more for entries of the lead or with a section of their own.
    """
    of_type = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv]), kind), F.lit(0.5))
    mention = F.log1p(weight) / F.log1p(F.greatest(most, F.lit(1.0))) + F.when(headed, 0.25).otherwise(0.0) + F.when(lead, 0.15).otherwise(0.0)
    return (0.5 * mention + 0.35 * fame) * (0.55 + 0.45 * of_type) * F.when(umbrella, 0.55).otherwise(1.0)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only, however rows are partitioned."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, each in proportion to its weight: the least -ln(u) / w."""
    return rows.where(F.col(weight) > 0).orderBy(-F.log(uniform(F.col(key), seed=seed)) / F.col(weight), key).limit(n)


def stride_sample(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows of each group, evenly spread over its order."""
    w = Window.partitionBy(group)
    numbered = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = F.floor(F.col("_r") * n / F.col("_n"))
    before = F.floor((F.col("_r") - 1) * n / F.col("_n"))
    return numbered.where((F.col("_n") <= n) | (F.col("_r") == 0) | (step != before)).drop("_r", "_n")


def chapter_of(years: Column, chapters: list[tuple[str, int, int]], slack: float = 0.25) -> Column:
    """The first chapter (name, from, to), widened by a share of its length between 30 and 300 years, that holds a year."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(chapters):
        tol = min(300.0, max(30.0, slack * (hi - lo)))
        out = F.when((years >= lo - tol) & (years <= hi + tol), F.lit(name)).otherwise(out)
    exact = F.lit(None).cast("string")
    for name, lo, hi in reversed(chapters):
        exact = F.when((years >= lo) & (years <= hi), F.lit(name)).otherwise(exact)
    return F.coalesce(exact, out)


def at_ranks(rows: DataFrame, group: str, value: str, **index: Column) -> DataFrame:
    """(group, n, a column for each index): values at places of a group's order, places as expressions of the count `n`.

    Ranks come from a window that spills, so no group is gathered into a row.
    """
    w = Window.partitionBy(group)
    known = rows.where(F.col(value).isNotNull()).select(group, value)
    ranked = known.withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    picked = [F.max(F.when(F.col("_r") == at, F.col(value))).alias(name) for name, at in index.items()]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *picked)


def middle(share: float) -> Column:
    """The place floor(share * (n - 1))."""
    return F.floor(F.lit(share) * (F.col("n") - 1))


def key_selection(rows: DataFrame, share: Column) -> DataFrame:
    """rows (id, chapter, type, title, importance) of each chapter's quota, max(4, half up of share): first events, up to
    half of it; then by importance, people up to 0.4 of it; then whatever is left.

    Places, groups and ideas take part only where `headed`; a chapter of nothing else keeps its best two.
    """
    order = [F.desc("importance"), "id"]
    w = Window.partitionBy("chapter")
    context = F.col("type").isin("place", "group", "concept") & ~F.col("headed")
    r = rows.withColumn("quota", F.greatest(F.lit(4), F.floor(share + 0.5))).withColumn("_usable", F.count_if(~context).over(w))
    r = r.withColumn("_o", F.row_number().over(w.orderBy(*order)))
    r = r.where(~context | ((F.col("_usable") == 0) & (F.col("_o") <= 2)))
    happened = (F.col("type") == "event") & ~F.lower("title").rlike(r"^(?:birth|death) of\b")
    r = r.withColumn("_e", F.when(happened, F.row_number().over(Window.partitionBy("chapter", happened).orderBy(*order))))
    first = F.coalesce(F.col("_e") <= F.ceil(F.col("quota") * 0.5), F.lit(False))
    person = F.col("type") == "person"
    r = r.withColumn("_first", first).withColumn("_p", F.row_number().over(Window.partitionBy("chapter", person).orderBy(*order)))
    late = person & (F.col("_p") > F.ceil(F.col("quota") * 0.4))
    stage = F.when(F.col("_first"), 0).when(~late, 1).otherwise(2)
    r = r.withColumn("_s", stage).withColumn("_k", F.row_number().over(w.orderBy("_s", *order)))
    return r.where(F.col("_k") <= F.col("quota")).select(*rows.columns)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with n, their place from 0 in an order that is total: ranges of it are sorted and numbered where they lie, and each
    adds the rows of the ranges before it, of which there is one number a partition.

    The numbered ranges are kept as a table, since ranges are drawn anew whenever a plan runs.
    """
    m = F.col("_m")
    dealt = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright(m, 33))  # partition and place, as Spark numbers rows
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = totals.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return dealt.join(F.broadcast(before), "_p").withColumn("n", m.bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b")).drop("_p", "_m", "_b")


def running_totals(rows: DataFrame, value: str, *order: Column) -> DataFrame:
    """rows with n, their place from 0, and before, the sum of value over the rows before them, in an order that is total.

    Ranges of the order are summed where they lie; what came before a range is a sum of one row a partition.
    """
    m = F.col("_m")
    dealt = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright(m, 33))
    upto = Window.orderBy("_p")
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_c"), F.sum(value).alias("_v"))
    start = totals.select("_p", (F.sum("_c").over(upto) - F.col("_c")).alias("_b"), (F.sum("_v").over(upto) - F.col("_v")).alias("_w"))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    both = dealt.withColumn("_i", F.coalesce(inside, F.lit(0))).join(F.broadcast(start), "_p")
    return both.withColumns({"n": m.bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b"), "before": F.col("_w") + F.col("_i")}).drop("_p", "_m", "_b", "_w", "_i")


# Fixed value: the step of the generator.
STEP = 0x6D2B79F5
_WORD = 1 << 32


def imul(a: Column, b: Column) -> Column:
    """The product of two unsigned numbers of 32 bits, modulo 2^32, without a product of more than 48 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + high) % _WORD


def draw(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) in [0, 1) of the seeded 32-bit generator, as any machine draws it: no state, so rows may come in any order."""
    a = F.pmod(F.pmod(seed.cast("long"), F.lit(_WORD)) + F.pmod(n.cast("long") * STEP, F.lit(_WORD)), F.lit(_WORD))
    xor = lambda x, bits: x.bitwiseXOR(F.shiftright(x, bits))
    steps = (
        lambda x: imul(xor(x, 15), x.bitwiseOR(F.lit(1))),
        lambda t: t.bitwiseXOR((t + imul(xor(t, 7), t.bitwiseOR(F.lit(61)))) % _WORD),
        lambda t: xor(t, 14),
    )
    out = F.array(a)
    for step in steps:  # one lambda a step: each is computed once
        out = F.transform(out, step)
    return out[0] / float(_WORD)
