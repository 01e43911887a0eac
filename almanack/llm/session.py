"""Session helpers: the shared checkpoint folder and eager cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named in spark.checkpoint.dir.

    Only where that setting is absent on one machine, as in tests, a temporary folder is made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read on from there, without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own setting that removes an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame) -> DataFrame:
    """Write df as a compressed table in the shared folder and read on from there.

    Smaller than a checkpoint, but rows come back in any order. Spark removes the shuffle files of
    this execution when it ends, so that a job's steps don't add up on disk; df itself must not be
    used again, but for what is derived from its sources anew.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    written = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    written.almanack_path = path
    return written


def drop(written: DataFrame) -> None:
    """Delete a table that write() returned and that nothing will read again."""
    context = written.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(written.almanack_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
