"""Questions from entries, their grading, and what is asked next. Draws depend on ids and a seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.functions import dates as D, strings as S
from almanack.operators.ranking import uniform

DEEP_TIME = 100_000


def order_questions(pool: DataFrame, seeds: DataFrame, n: int = 4, apart: int = 2, near: int = 1, seed: int = 0) -> DataFrame:
    """(seed, items): for each seed (id) four entries of the pool (id, chapter, anchor) from its chapter or the next ones to put in order, any two
    at least two years apart; seeds without four make none.

    The draw goes over years, of which a score is enough: a year's number is the least of as many as it has entries, and of those
    one is drawn by its place. So seeds meet the years around their chapter, not its entries.
    """
    around = pool.select("id", "anchor", F.explode(F.sequence(F.col("chapter") - near, F.col("chapter") + near)).alias("c"))
    placed = around.withColumn("place", F.row_number().over(Window.partitionBy("c", "anchor").orderBy("id")) - 1)
    years = around.groupBy("c", "anchor").agg(F.count("*").alias("of"))
    s = pool.join(seeds.select("id"), "id", "left_semi").select(F.col("id").alias("seed"), F.col("chapter").alias("c"), F.col("anchor").alias("y"))
    met = s.join(years, "c").where(F.abs(F.col("anchor") - F.col("y")) >= F.greatest(F.lit(apart), F.lit(1)))
    drawn = met.withColumn("u", 1 - F.pow(1 - uniform(F.col("seed"), F.col("anchor"), seed=seed), 1 / F.col("of")))
    few = drawn.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("u", "anchor"))).where("r <= 40")
    lists = few.groupBy("seed", "c", "y").agg(F.sort_array(F.collect_list(F.struct("u", "anchor", "of"))).alias("xs"))
    first = F.array(F.struct(F.col("y").alias("anchor"), F.lit(0).cast("long").alias("of")))

    def step(out, x):
        clash = F.exists(out, lambda o: F.abs(o["anchor"] - x["anchor"]) < apart)
        return F.when((F.size(out) >= n) | clash, out).otherwise(F.concat(out, F.array(F.struct(x["anchor"].alias("anchor"), x["of"].alias("of")))))

    chosen = lists.select("seed", "c", F.aggregate("xs", first, step).alias("items")).where(F.size("items") == n).select("seed", "c", F.posexplode("items").alias("at", "x"))
    place = F.floor(uniform(F.col("seed"), F.col("x.anchor"), seed=seed + 1) * F.col("x.of"))
    wanted = chosen.select("seed", "c", "at", F.col("x.anchor").alias("anchor"), place.cast("int").alias("place"))
    drawn = wanted.where("at > 0").join(placed, ["c", "anchor", "place"]).select("seed", "at", "anchor", "id")
    both = drawn.unionByName(wanted.where("at = 0").select("seed", "at", "anchor", F.col("seed").alias("id")))
    items = F.transform(F.sort_array(F.collect_list(F.struct("at", "anchor", "id"))), lambda x: F.struct(x["anchor"].alias("anchor"), x["id"].alias("id")))
    return both.groupBy("seed").agg(items.alias("items"))


def choice_questions(pool: DataFrame, group: str, n: int = 4, seed: int = 0) -> DataFrame:
    """(id, answer, choices): which group (era, chapter) an entry is of, among n groups in a drawn order."""
    groups = pool.select(group).distinct()
    listed = groups.agg(F.sort_array(F.collect_set(group)).alias("gs"))  # chapters or eras of a topic: a few
    q = pool.join(F.broadcast(listed)).select("id", F.col(group).alias("answer"), "gs")
    draw = lambda g: F.xxhash64(F.col("id").cast("string"), g.cast("string"), F.lit(seed))
    others = F.slice(F.transform(F.array_sort(F.transform(F.filter("gs", lambda g: g != F.col("answer")), lambda g: F.struct(draw(g).alias("u"), g.alias("g")))), lambda x: x["g"]), 1, n - 1)
    mixed = F.array_sort(F.transform(F.concat(F.array("answer"), others), lambda g: F.struct(F.xxhash64(g.cast("string"), F.col("id").cast("string"), F.lit(seed + 1)).alias("u"), g.alias("g"))))
    return q.select("id", "answer", F.transform(mixed, lambda x: x["g"]).alias("choices"))


def grade_year(typed: Column, want: Column) -> Column:
    """struct(ok, delta): the first number typed against a year, within the year's tolerance; deep years need no sign."""
    got = F.get(D.typed_years(F.trim(typed)), F.lit(0))
    got = F.when(F.abs(want) > DEEP_TIME, F.signum(want.cast("double")).cast("long") * F.abs(got)).otherwise(got)
    return F.struct(F.coalesce(F.abs(got - want) <= D.year_tolerance(want), F.lit(False)).alias("ok"), (got - want).alias("delta"))


def grade_span(typed: Column, start: Column, end: Column) -> Column:
    """struct(ok, delta): two numbers typed against a span; the wider tolerance counts for both."""
    got = D.typed_years(F.trim(typed))
    a, b = F.get(got, F.lit(0)), F.get(got, F.lit(1))
    slack = F.greatest(D.year_tolerance(start), D.year_tolerance(end))
    return F.struct(F.coalesce((F.abs(a - start) <= slack) & (F.abs(b - end) <= slack), F.lit(False)).alias("ok"), (a - start).alias("delta"))


def grade_text(typed: Column, answer: Column) -> Column:
    return F.struct(S.answer_matches(typed, answer).alias("ok"), F.lit(None).cast("long").alias("delta"))


def ask_weight(last: Column, due: Column, wrong: Column, now: int) -> Column:
    """How likely an entry is asked: missed ones most, then due, unseen, once missed, and known ones."""
    return F.when(last.isNull(), 3.0).when(last == 0, 5.0).when(due <= now, 4.0).when(wrong > 0, 0.6).otherwise(0.25)


def session_items(items: DataFrame, now: int, n: int = 12, seed: int = 0) -> DataFrame:
    """The n entries (id, opened, due, last, wrong) of a mixed session: all that are due first, then of opened topics, then any; drawn by weight."""
    due = F.coalesce(F.col("due") <= now, F.lit(False))
    stage = F.when(due, 0).when(F.col("opened"), 1).otherwise(2)
    weight = ask_weight(F.col("last"), F.col("due"), F.col("wrong"), now)
    drawn = -F.log(uniform(F.col("id"), seed=seed)) / weight
    return items.withColumns({"stage": stage, "_u": drawn}).orderBy("stage", "_u", "id").limit(n).drop("_u")
