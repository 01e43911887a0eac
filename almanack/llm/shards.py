"""Contiguous shards of equal bytes by global prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.session import cut


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in the order of their ids, into contiguous shards of nearly equal bytes.

    The text is read once, in place, for its size (UTF-8 bytes plus 1; null text: 1) and CRC-32
    (null text: that of no bytes). Only these small rows are range-partitioned by id and sorted.
    The totals of the partitions, one row each, give every partition its byte and row offsets; a
    row whose middle byte lies in [i, i + 1) / shards of the total goes to shard i. slot is the
    place within the shard.

    Null ids come first; rows of one id are ordered by CRC and size, and equal rows are
    interchangeable. An empty table gives no rows. Other columns are not read.
    """
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = ["doc_id", "text_crc32", "size"]
    ordered = cut(small.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))

    # one row for each partition: as many as the partitions, whatever the documents
    totals = sorted(ordered.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    before, bytes_so_far, rows_so_far = {}, 0, 0
    for part, n_bytes, n_rows in totals:
        before[part] = (bytes_so_far, rows_so_far)
        bytes_so_far, rows_so_far = bytes_so_far + n_bytes, rows_so_far + n_rows
    total = max(1, bytes_so_far)

    def place(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            if at is None:
                at = before[batch.column("part")[0].as_py()]
            start = at[0] + np.cumsum(size) - size
            # Python integers where products could pass 2^63
            wide = total > (1 << 62) // (2 * shards)
            middle = (2 * start + size).astype(object) if wide else 2 * start + size
            shard = np.minimum(shards - 1, middle * shards // (2 * total)).astype(np.int32)
            row = at[1] + np.arange(batch.num_rows)
            at = (int(start[-1] + size[-1]), at[1] + batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(shard), pa.array(row)],
                ["doc_id", "size", "text_crc32", "shard", "row"],
            )

    kind = dict(small.dtypes)["doc_id"]
    placed = ordered.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, row long")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    starts = F.create_map(*(F.lit(x) for pair in (first or {0: 0}).items() for x in pair))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.element_at(starts, F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
