"""The entry store: vectors, ideas, appended chunks, aliases, and layouts that are served by range, row and word."""

from __future__ import annotations

import csv
import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from almanack.functions.strings import first_sentence, index_tokens, shard_of
from almanack.functions.text import short_picture, strip_apparatus
from almanack.operators.ranking import numbered
from almanack.operators.vectors import quantise
from almanack.session import keep

# files --------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def swap(spark: SparkSession, staged: str, live: str) -> None:
    """Put a finished folder in the place of another; the old one goes only once the new one is whole."""
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, live)
    _, aside = _fs(spark, f"{live}-old-{uuid.uuid4().hex}")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"could not move {live} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"could not put {staged} in the place of {live}")
    fs.delete(aside, True)


def replace(rows: DataFrame, live: str, **options) -> None:
    """Write rows beside a table and swap them in, so a reader sees the old table or the new one."""
    staged = f"{live}-new-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(staged)
    swap(rows.sparkSession, staged, live)


def read_document(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame | None:
    """A whole JSON document as a table, or the fallback where there is none."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else fallback


def write_document(rows: DataFrame, path: str) -> None:
    """JSON lines, swapped in whole."""
    staged = f"{path}-new-{uuid.uuid4().hex}"
    rows.write.json(staged)
    swap(rows.sparkSession, staged, path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted where it must be; the first time a table is replaced, the one before stays as <path>.bak."""
    spark, staged = rows.sparkSession, f"{path}-new-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(staged)
    if exists(spark, path) and not exists(spark, f"{path}.bak"):
        fs, old = _fs(spark, path)
        fs.rename(old, _fs(spark, f"{path}.bak")[1])
    swap(spark, staged, path)


@F.pandas_udf(T.StringType())
def csv_line(cells: pd.Series) -> pd.Series:
    """A line of minimal quotes from an array of strings."""

    def one(values):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["" if v is None else v for v in values])
        return out.getvalue()

    return cells.map(one)


# entries ------------------------------------------------------------------------------------------------


def append_entries(spark: SparkSession, rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Further chunks of a store; no row of an older one is read or written again."""
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def replace_group(rows: DataFrame, live: str, column: str) -> None:
    """Replace the rows of the groups that occur in rows (a column the table is partitioned by), and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(live)


def rewrite_changed(rows: DataFrame, path: str, chunks: int, key: str = "id") -> list[int]:
    """Write rows as `chunks` folders by a hash of their key, but only those whose rows differ from what is there; the chunks written.

    A chunk is told by the sum and the parity of its rows' hashes: two numbers a chunk reach the driver.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
    names = sorted(rows.columns)

    def marks(d: DataFrame) -> dict:
        h = F.xxhash64(*[F.col(c) for c in names])
        return {r.chunk: (r.n, r.x) for r in d.groupBy("chunk").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x")).collect()}

    old = marks(spark.read.parquet(path)) if exists(spark, path) else {}
    new = marks(dealt)
    changed = sorted(c for c in new if old.get(c) != new[c])
    if changed:
        dealt.where(F.col("chunk").isin(changed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    for gone in old.keys() - new.keys():
        delete(spark, f"{path}/chunk={gone}")
    return changed


def ideas_by_name(ideas: DataFrame) -> DataFrame:
    """(key, id) of undated ideas (id, title, asked, missing): by title and by the name they were asked under."""
    live = ideas.where(~F.coalesce("missing", F.lit(False)))
    keys = F.array_distinct(F.filter(F.array(F.lower("title"), F.lower("asked")), lambda x: x.isNotNull()))
    return live.select(F.explode(keys).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))


def lite_rows(entries: DataFrame, members: DataFrame, prefix: str) -> DataFrame:
    """What a browser needs of dated entries, nulls where there is nothing: short descriptions and pictures, a first sentence
    that doesn't repeat the title, fame from 0 to 9, and the topics (members: id, topics) an entry is in."""
    said = first_sentence(strip_apparatus(F.col("excerpt")), 160)
    repeats = F.startswith(F.lower(said), F.left(F.lower(F.regexp_replace("title", r"…\z", "")), F.lit(30)))
    return entries.where("start IS NOT NULL").join(members, "id", "left").select(
        "id", "title", "start", F.when(F.col("end") != F.col("start"), F.col("end")).alias("end"), F.when(F.col("kind") == "span", 1).alias("span"),
        F.when(F.length("subtitle") <= 90, F.col("subtitle")).alias("subtitle"), short_picture(F.col("image"), prefix).alias("image"),
        F.when((said != "") & ~repeats, said).alias("sentence"), F.when(F.col("sitelinks") > 0, F.least(F.lit(9), F.floor(F.log1p("sitelinks") + 0.5))).alias("fame"), "topics",
    )


# vectors ------------------------------------------------------------------------------------------------


def packed(v: Column) -> Column:
    """Bytes of a vector: its scale as a little-endian float, then its values in one byte each."""

    @F.pandas_udf(T.BinaryType())
    def pack(scale: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([np.float32(s).astype("<f4").tobytes() + np.asarray(x, np.int8).tobytes() for s, x in zip(scale, q)])

    q = quantise(v)
    return pack(q["scale"], q["q"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpacked(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: np.frombuffer(b, np.int8, offset=4).astype(float) * float(np.frombuffer(b, "<f4", count=1)[0]))


def write_vectors(rows: DataFrame, path: str, mode: str = "append", rows_per_file: int = 25_000) -> None:
    """rows (id, vector) as (id, dim, packed), at most 25,000 a file."""
    rows.select("id", F.size("vector").alias("dim"), packed(F.col("vector")).alias("packed")).write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector); a row whose bytes are not 4 and one for each dimension stops the read."""
    raw = spark.read.parquet(path)
    whole = F.when(F.length("packed") == 4 + F.col("dim"), F.col("packed")).otherwise(F.raise_error(F.concat(F.lit("row count drifted at "), F.col("id").cast("string"))).cast("binary"))
    return raw.select("id", unpacked(whole).alias("vector"))


def import_matrix(spark: SparkSession, path: str, ids: DataFrame, dim: int) -> DataFrame:
    """(id, vector) of raw 32-bit floats, row by row in files, for the ids (row, id) that are alive.

    A file's rows are numbered from the sizes of the files before it by name, of which there is one number a file.
    """
    files = spark.read.format("binaryFile").load(path)
    before = files.select("path", "length").withColumn("first", (F.sum("length").over(Window.orderBy("path")) - F.col("length")) / (4 * dim)).select("path", F.col("first").cast("long").alias("first"))

    def rows(batches):
        for pdf in batches:
            for content, first in zip(pdf["content"], pdf["first"]):
                m = np.frombuffer(content, "<f4").reshape(-1, dim).astype(float)
                yield pd.DataFrame({"row": np.arange(len(m)) + first, "vector": list(m)})

    return files.join(before, "path").select("content", "first").mapInPandas(rows, "row long, vector array<double>").join(ids, "row").select("id", "vector")


# layouts that are served ----------------------------------------------------------------------------------


#: Blocks of row numbers that lie in one folder, sorted, so that a file's statistics tell which of its parts to read.
FOLDER = 1_000


def buckets_of(counts: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """(bucket, lo, hi) of consecutive keys in buckets of about `size` rows: by the rows before a key, so that keys stay whole
    and every key is dealt where it lies. hi is the key before the next bucket, null in the last."""
    ordered = counts.select(key, n)
    run = F.sum(n).over(Window.orderBy(key)) - F.col(n)  # one row a key
    b = ordered.withColumn("_b", F.floor(run / size)).groupBy("_b").agg(F.min(key).alias("lo"))
    w = Window.orderBy("lo")
    return b.select((F.row_number().over(w) - 1).alias("bucket"), "lo", (F.lead("lo").over(w) - 1).alias("hi"))


def deal_to_buckets(rows: DataFrame, buckets: DataFrame, last: Column, most: int = 6) -> DataFrame:
    """rows (id, start, ...) with bucket: that of their start and every later one they reach up to `last`; a row in more than
    `most` comes once, in bucket -1. Bounds are a sorted array of one number a bucket, searched in each row."""
    bounds = F.broadcast(buckets.agg(F.sort_array(F.collect_list("lo")).alias("_los")))
    place = lambda y: F.greatest(F.lit(0), F.size(F.filter("_los", lambda lo: lo <= y)) - 1)
    r = rows.join(bounds).withColumns({"_a": place(F.col("start")), "_z": place(last)})
    to = F.when(F.col("_z") - F.col("_a") + 1 > most, F.array(F.lit(-1))).otherwise(F.sequence("_a", F.greatest("_a", "_z")))
    return r.withColumn("bucket", F.explode(to)).drop("_los", "_a", "_z")


def write_layout(rows: DataFrame, path: str, size: int, now: int, words: Column | None = None, most: int = 6, block: int = 100) -> None:
    """A served copy of rows (id, start, end, open_ended, topic, fame, has_image, ...): time/ by bucket, with a table of their bounds,
    rows/ by block of row numbers, a folder for FOLDER blocks in their order, and words/ by the first two letters, if words are given. All folders
    are swapped in as one."""
    spark, staged = rows.sparkSession, f"{path}-new-{uuid.uuid4().hex}"
    last = F.when(F.coalesce("open_ended", F.lit(False)), F.lit(now)).otherwise(F.coalesce("end", "start"))
    counts = rows.where("start IS NOT NULL").groupBy("start").agg(F.count("*").alias("n"))
    bounds = buckets_of(counts, "start", "n", size)
    bounds.coalesce(1).write.parquet(f"{staged}/bounds")
    kept = spark.read.parquet(f"{staged}/bounds")
    deal_to_buckets(rows.where("start IS NOT NULL"), kept, last, most).repartition("bucket").write.partitionBy("bucket").parquet(f"{staged}/time")
    order = [F.col("topic").isNull(), F.desc("fame"), F.desc("has_image"), F.asc("id")]
    flat = rows.select("*", F.col("topic").isNull().alias("_o"))
    order[0] = F.asc("_o")
    placed = numbered(flat, *order).drop("_o").withColumn("block", F.floor(F.col("n") / block)).withColumn("blocks", F.floor(F.col("block") / FOLDER))
    placed.repartition("blocks").sortWithinPartitions("blocks", "n").write.partitionBy("blocks").parquet(f"{staged}/rows")
    if words is not None:
        numbers = spark.read.parquet(f"{staged}/rows").select("id", "n")
        terms = rows.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("f"))
        index = terms.join(numbers, "id").select(shard_of(F.col("term")).alias("shard"), "term", "n", F.round(F.col("f") / (F.col("f") + 1.2), 3).alias("weight"))
        index.repartition("shard").write.partitionBy("shard").parquet(f"{staged}/words")
    swap(spark, staged, path)


def rows_between(spark: SparkSession, path: str, lo: int, hi: int, now: int, most: int = 40) -> tuple[DataFrame, bool]:
    """(rows under way in [lo, hi], once each; partial): only the folders of the buckets that the range meets are read, and the long
    rows. A range over more than `most` buckets reads half as many at either end, and says so."""
    met = spark.read.parquet(f"{path}/bounds").where((F.col("lo") <= hi) & F.coalesce(F.col("hi") >= lo, F.lit(True))).orderBy("bucket")
    n = met.count()
    ends = [r.bucket for d in (F.asc("bucket"), F.desc("bucket")) for r in met.orderBy(d).limit(most // 2 if n > most else n).collect()]
    rows = spark.read.parquet(f"{path}/time").where(F.col("bucket").isin(sorted({*ends, -1})))
    last = F.when(F.coalesce("open_ended", F.lit(False)), F.lit(now)).otherwise(F.coalesce("end", "start"))
    return rows.where((F.col("start") <= hi) & (last >= lo)).drop("bucket").dropDuplicates(["id"]), n > most


def buckets_to_load(bounds: DataFrame, loaded: DataFrame, lo: int, hi: int, most: int = 10) -> DataFrame:
    """The buckets (bucket, lo, hi) that a view of [lo, hi] lacks: those nearest its middle first, at most `most` at once."""
    met = bounds.where((F.col("lo") <= hi) & F.coalesce(F.col("hi") >= lo, F.lit(True))).join(loaded.select("bucket"), "bucket", "left_anti")
    return met.orderBy(F.abs((F.col("lo") + F.coalesce("hi", "lo")) / 2 - (lo + hi) / 2), "bucket").limit(most)


def rows_by_number(spark: SparkSession, path: str, numbers: DataFrame, per: int = 100) -> DataFrame:
    """The rows of a layout with the numbers (n) asked for, from their blocks alone."""
    blocks = [r.b for r in numbers.select(F.floor(F.col("n") / per).alias("b")).distinct().limit(10_000).collect()]  # a page of hits
    folders = sorted({b // FOLDER for b in blocks})
    return spark.read.parquet(f"{path}/rows").where(F.col("blocks").isin(folders) & F.col("block").isin(blocks)).drop("blocks").join(numbers, "n")


def find_rows(spark: SparkSession, path: str, words: str, limit: int = 200, most: int = 6) -> DataFrame:
    """(n, score, have): the best rows for at most six distinct words, from those words' shards alone."""
    from almanack.operators.search import rank_index

    one = spark.range(1).select(F.slice(F.array_distinct(index_tokens(F.lit(words))), 1, most).alias("ts")).first()
    shards = sorted({t[:2] if len(t) >= 2 else "__" for t in one.ts})
    postings = spark.read.parquet(f"{path}/words").where(F.col("shard").isin(shards) & F.col("term").isin(one.ts))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    total = spark.read.parquet(f"{path}/rows").count()
    return rank_index(postings.join(F.broadcast(df), "term").withColumnRenamed("n", "id"), total, one.ts).withColumnRenamed("id", "n").orderBy(F.desc(F.round("score", 9)), "n").limit(limit)


def next_fit(items: DataFrame, capacity: int, *order) -> DataFrame:
    """items (size, ...) with bin: in order each goes into the bin at hand, or opens the next one if that would hold more than capacity.

    No task sees all items. Prefix sums tell, for each item as the first of a bin, which one the next bin would open with: an equi-join on
    cells of one capacity, each cell holding the few items that cross it. Which items do open bins is found by pointer
    doubling: jumps of 1, 2, 4, ... bins, each the join of the one before with itself, and then the reached set doubled from
    the largest jump down. Sizes are whole and at least 1; one larger than capacity has a bin of its own.
    """
    from almanack.operators.ranking import running_totals

    r = keep(running_totals(items, "size", *order))
    at = r.select(F.col("n").alias("i"), "before", (F.col("before") + F.col("size")).alias("after"))
    want = at.select("i", (F.col("before") + capacity).alias("full")).withColumn("cell", F.floor(F.col("full") / capacity))
    cells = at.select(F.col("i").alias("j"), F.col("before").alias("lo"), F.col("after").alias("hi"), F.explode(F.sequence(F.floor(F.col("before") / capacity), F.floor(F.col("after") / capacity))).alias("cell"))
    opens = want.join(cells, "cell").where("full >= lo AND full < hi").select("i", F.greatest("j", F.col("i") + 1).alias("j"))
    jump = keep(opens)  # no row: no bin after it; a null would meet all others in one task
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = keep(jump.join(jump.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")))
    reached = at.where("i = 0").select("i", F.lit(0).cast("long").alias("bin"))
    for k in reversed(range(len(jumps))):
        ahead = reached.join(jumps[k], "i").select(F.col("j").alias("i"), (F.col("bin") + (1 << k)).alias("bin"))
        reached = keep(reached.unionByName(ahead))
    top = at.agg(F.max("i")).first()[0]
    ends = reached.join(jumps[0] if jumps else jump, "i", "left").select("i", "bin", F.coalesce(F.col("j") - 1, F.lit(top).cast("long")).alias("last"))
    of = ends.select("bin", F.explode(F.sequence("i", "last")).alias("n"))
    return r.join(of, "n").drop("n", "before")


def detail_groups(rows: DataFrame, part: int = 200, size: int = 200) -> DataFrame:
    """(id, leaf, part, file) of rows (id, leaf, seq): a leaf's rows in parts of 200 in order, and parts in files of 200 rows at most, next fit."""
    r = keep(rows.withColumn("_r", F.row_number().over(Window.partitionBy("leaf").orderBy("seq")) - 1).withColumn("part", F.floor(F.col("_r") / part)))
    parts = r.groupBy("leaf", "part").agg(F.count("*").alias("size"))
    files = next_fit(parts, size, F.asc("leaf"), F.asc("part")).select("leaf", "part", F.col("bin").alias("file"))
    return r.join(files, ["leaf", "part"]).select("id", "leaf", "part", "file")


def pages_of(rows: DataFrame, order: str, size: int = 500) -> DataFrame:
    """rows with page: at most `size` each, in order."""
    return numbered(rows, F.asc(order)).withColumn("page", F.floor(F.col("n") / size)).drop("n")


def publish(spark: SparkSession, path: str, target: str) -> int:
    """Copy a finished folder to another place and swap it in there; the number of its files."""
    context = spark.sparkContext
    fs, source = _fs(spark, path)
    staged = f"{target}-new-{uuid.uuid4().hex}"
    to_fs, to = _fs(spark, staged)
    context._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, context._jsc.hadoopConfiguration())
    n = fs.getContentSummary(source).getFileCount()
    swap(spark, staged, target)
    return int(n)
