"""The shared folder of a cluster, for results that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only on one machine without that setting, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over as many tasks as spark.sql.shuffle.partitions says, by columns if any: a small table lies in one file and is read by one task, and
    small shuffles are merged into few, however much work each row is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut(df: DataFrame) -> DataFrame:
    """df from the shared folder, without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, for results that are read more than once."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
