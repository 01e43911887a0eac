"""Readers of entry stores, tables, job lists and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def entry_schema() -> T.StructType:
    """The fixed schema of an entry."""
    s, b, n, words = T.StringType(), T.BooleanType(), T.LongType(), T.ArrayType(T.StringType())
    origin = T.StructType([T.StructField(c, b if c == "manual" else s) for c in ("dataset", "wiki", "qid", "manual", "dateSource")])
    kinds = {
        "id": s, "title": s, "subtitle": s, "yearText": s, "start": n, "end": n, "kind": s, "circa": b, "openEnded": b, "domains": words, "topics": words,
        "facets": T.MapType(s, words), "excerpt": s, "image": s, "sitelinks": T.IntegerType(), "origin": origin, "addedAt": s,
    }
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as entries; broken lines come out in _corrupt_record for check_broken()."""
    return spark.read.schema(entry_schema().add("_corrupt_record", T.StringType())).json(path, mode="PERMISSIVE")


def write_entries(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """A fresh set of chunks; fields without a value are left out."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "none").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted values with doubled quotes, trimmed, all strings."""
    return spark.read.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def map_columns(rows: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Select by a declarative table of target to source; rows without a year go."""
    out = rows.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])
    return out.where(F.col("yearText").isNotNull() & (F.trim("yearText") != "")) if "yearText" in mapping else out


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, options) of lines `page | k=v; v2`, # comments left out, `1888..1890 in film` expanded."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split("value", r"\s*\|\s*")
    named = lines.select(F.trim(parts[0]).alias("name"), F.slice(parts, 2, 99).alias("o"))
    lo, hi = F.regexp_extract("name", r"^(\d+)\.\.(\d+)", 1), F.regexp_extract("name", r"^(\d+)\.\.(\d+)", 2)
    years = F.when(lo != "", F.sequence(lo.try_cast("int"), hi.try_cast("int")))
    names = F.coalesce(F.transform(years, lambda y: F.concat(y.cast("string"), F.regexp_replace("name", r"^\d+\.\.\d+", ""))), F.array("name"))
    options = F.map_from_entries(F.transform("o", lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.transform(F.split(F.regexp_replace(x, "^[^=]*=", ""), ";"), lambda v: F.trim(v)).alias("v"))))
    return named.select(F.explode(names).alias("name"), options.alias("options"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(title, year_text, body) of blocks between blank lines; the first line is the title."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).where(F.trim("b") != "")
    lines = F.split(F.regexp_replace("b", r"^\s+|\s+\z", ""), "\n")
    year = F.regexp_extract("b", r"(?im)^year:\s*(.+)$", 1)
    body = F.array_join(F.filter(F.slice(lines, 2, 1_000_000), lambda x: ~x.rlike(r"(?i)^year:")), "\n")
    return blocks.select(F.trim(lines[0]).alias("title"), F.when(year != "", year).alias("year_text"), body.alias("body"))


def clean_html(c: Column) -> Column:
    """Text of a page: scripts, styles and navigation out, a line for each block, tags out, common entities read."""
    c = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|h[1-6]|tr|section|article|ul|ol|table)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+\z", "")
