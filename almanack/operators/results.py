"""Winners out of tables of results, by recipes that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanack.functions.when import season_year
from almanack.operators.extract import NOT_HELD
from almanack.operators.tables import table_rows
from almanack.session import keep, spread

# Headers of columns.
YEAR = r"(?i)^(year|season|date)"
WIN = r"(?i)^(winn(er|ing team|ers)|champions?\b|champion \(|horse$)"
LOSE = r"(?i)^(los(er|ing team)|runners?-?up)"
SCORE = r"(?i)^(score|final score|series|games|result|winning margin|margin)$"
#: Shares in which the rows of a table are dealt.
SHARES = 16
#: A recipe: the page's title, what is won ({game} is a cell), patterns of headers where they aren't the usual ones, and what is wanted.
RECIPE = (
    "title string, comp string, win string, game string, extra string, extra_label string, between array<string>, columns array<struct<header: string, name: string>>, "
    "one boolean, every boolean, two_scores boolean, no_loser boolean"
)


def tidy_cell(c: Column) -> Column:
    """A cell without notes, tallies in brackets and signs of footnotes."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", "")
    c = F.regexp_replace(c, r"\s*\((?:\d+(?:[,/]\s*\d+[–-]\d+)?|\d+/\d+|[A-Z]{1,4})\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[†‡*#§¤^]+", ""), r"\s+", " "))


def _place(pattern: Column) -> Column:
    """The place of the first header that matches, null without one or without a pattern."""
    found = F.array_position(F.transform("head", lambda h: F.coalesce(F.regexp_like(h, pattern), F.lit(False))), True)
    return F.when(found > 0, found - 1).cast("int")


def _share(c: Column, pattern: str) -> Column:
    return F.avg(c.rlike(pattern).cast("double"))


def body_columns(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """(page, table, season, score): the first columns whose cells read as years, and as scores, in at least that share of the rows. What a header
    doesn't name, the cells may. Sums before the shuffle: a table of many rows is a few numbers a task."""
    cells = rows.select("page", "table", F.posexplode("cells").alias("j", "cell"))
    said = F.col("cell.text")
    stats = cells.groupBy("page", "table", "j").agg(_share(said, r"^\s*(?:1[6-9]\d\d|20\d\d)(?:\s*[–-]\s*\d{2,4})?\s*(?:\[|$)").alias("year"), _share(said, r"^\s*\d+\s*[–-]\s*\d+").alias("score"))
    return stats.groupBy("page", "table").agg(F.min(F.when(F.col("year") >= least, F.col("j"))).alias("season_at"), F.min(F.when((F.col("score") >= least) & (F.col("year") < least), F.col("j"))).alias("score_at"))


def mine_results(pages: DataFrame, recipes: DataFrame, now: int) -> DataFrame:
    """(page, year, title, sentence) of pages (page, title, html) for whose title there is a recipe: each winner of each row, once. A page may come in
    parts, rows with a column `part` that says their order, so none is ever whole in memory.

    Columns are found by their headers, the year and the score else by their cells. Of several tables with a year and a winner the one of most
    rows is read, or every one. A season counts in the year it ended in; rows without a winner, not held, or after `now` are left out. between: two
    columns of which the bold one won, and a score that is turned round if that is the second. columns: each names the winner of
    another competition. Recipes are few and stay a table; pages without one go before their tables are read.
    """
    asked = keep(pages.select("page", "title").distinct().join(recipes, "title"))
    # pages are dealt over tasks, and parsed once; their tables are told of in one row each
    read = keep(table_rows(spread(pages, "page").join(asked.select("page").distinct().hint("shuffle_hash"), "page")))
    rows = read.where("row IS NOT NULL").select("page", "table", "row", "cells")
    per = read.where("row IS NULL").select("page", "table", "head", "n", "place")
    per = per.join(asked, "page").join(body_columns(rows), ["page", "table"], "left")
    pattern = lambda c, usual: F.coalesce(F.col(c), F.lit(usual))
    head = lambda usual: _place(F.lit(usual))
    per = per.withColumns({
        "y": F.coalesce(head(YEAR), F.col("season_at")), "w": _place(pattern("win", WIN)), "l": F.when(F.coalesce("no_loser", F.lit(False)), None).otherwise(head(LOSE)), "s": F.coalesce(head(SCORE), F.col("score_at")),
        "g": _place(F.col("game")), "x": _place(F.col("extra")), "a": _place(F.get("between", F.lit(0))), "b": _place(F.get("between", F.lit(1))),
    })
    at = lambda i: tidy_cell(F.get("cells", i)["text"])
    two, one = F.col("between").isNotNull(), F.coalesce("one", F.lit(False))
    verb = F.when(one, "wins").otherwise("win")
    year = season_year(at(F.col("y")))
    of_columns = F.filter(F.transform("columns", lambda c: F.struct(F.array_position(F.transform("head", lambda h: F.regexp_like(h, c["header"])), True).alias("i"), c["name"].alias("name"))), lambda c: c["i"] > 0)
    scores = F.filter(F.transform("head", lambda h, i: F.when(F.regexp_like(h, F.lit("(?i)^score$")), i).otherwise(-1)), lambda i: i >= 0)
    per = per.withColumns({"many": of_columns, "scores": scores})
    usable = F.col("y").isNotNull() & F.when(F.col("columns").isNotNull(), F.size("many") >= 2).when(two, F.col("a").isNotNull() & F.col("b").isNotNull()).otherwise(F.col("w").isNotNull())
    per = keep(per.where(usable).drop("head"))
    best = per.groupBy("page").agg(F.max(F.struct("n", (-F.col("place")).alias("t"))).alias("m"))
    per = per.join(best, "page").where(F.coalesce("every", F.lit(False)) | (F.col("place") == -F.col("m.t")))
    # rows of a long table are dealt over many tasks, and stream past what is known of their tables
    dealt = spread(rows.withColumn("share", F.col("row") % SHARES).drop("row"), "page", "table", "share")
    rows = dealt.join(per.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).hint("shuffle_hash"), ["page", "table", "share"])

    bold = lambda i: F.coalesce(F.get("cells", i)["bold"], F.lit(False))
    flip = two & ~bold(F.col("a"))
    winner = F.when(two, F.when(bold(F.col("a")) == bold(F.col("b")), "").when(flip, at(F.col("b"))).otherwise(at(F.col("a")))).otherwise(at(F.col("w")))
    loser = F.when(two, F.when(flip, at(F.col("a"))).otherwise(at(F.col("b")))).when(F.col("l").isNotNull(), at(F.col("l"))).otherwise("")
    score = F.when(F.coalesce("two_scores", F.lit(False)) & (F.size("scores") >= 2), F.concat_ws("–", at(F.get("scores", F.lit(0))), at(F.get("scores", F.lit(1))))).when(F.col("s").isNotNull(), at(F.col("s"))).otherwise("")
    score = F.when(flip, F.array_join(F.reverse(F.split(score, "[–-]")), "–")).otherwise(score)
    comp = F.trim(F.replace(F.coalesce("comp", F.lit("")), F.lit("{game}"), F.when(F.col("g").isNotNull(), at(F.col("g"))).otherwise("")))
    extra = F.when(F.col("x").isNotNull(), at(F.col("x"))).otherwise("")
    found = F.when(F.col("columns").isNotNull(), F.transform("many", lambda c: F.struct(at(c["i"] - 1).alias("winner"), c["name"].alias("comp"), F.lit("").alias("loser"), F.lit("").alias("score"), F.lit("").alias("extra"))))
    found = found.otherwise(F.array(F.struct(winner.alias("winner"), comp.alias("comp"), loser.alias("loser"), score.alias("score"), extra.alias("extra"))))
    won = rows.select("page", year.alias("year"), verb.alias("verb"), one.alias("one"), "extra_label", F.explode(found).alias("r")).select("page", "year", "verb", "one", "extra_label", "r.*")
    won = won.where(F.col("year").isNotNull() & (F.col("year") <= now) & (F.col("winner") != "") & ~F.col("winner").rlike(NOT_HELD) & (F.length("winner") <= 60))
    title = F.concat_ws(" ", "winner", "verb", "comp")
    margin = F.when(F.col("score") == "", "").when(F.col("score").rlike(r"runs|wickets|up\b|&"), F.concat(F.lit(" by "), "score")).otherwise(F.concat(F.lit(" "), "score"))
    beat = F.when(F.col("loser") != "", F.concat(F.lit(", beating "), "loser", margin)).when((F.col("score") != "") & ~F.col("one"), F.concat(F.lit(" ("), "score", F.lit(")"))).otherwise("")
    more = F.when(F.col("extra") == "", "").when(F.col("extra_label").isNotNull(), F.concat_ws(" ", F.lit(","), "extra_label", "extra")).otherwise(F.concat(F.lit(" ("), "extra", F.lit(")")))
    more = F.regexp_replace(more, "^ ,|^, ", ", ")
    said = won.select("page", "year", title.alias("title"), F.concat(F.col("year").cast("string"), F.lit(" – "), title, beat, more, F.lit(".")).alias("sentence"))
    # hardly a title comes twice in a task, so rows aren't sorted to be summed before they are dealt
    return spread(said, "page", "year", "title").groupBy("page", "year", "title").agg(F.min("sentence").alias("sentence"))
