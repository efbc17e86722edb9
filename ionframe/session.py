"""Folders for intermediate results, and cutting lineage between stages."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the session's ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set, a local session gets a temporary one; anywhere else that is an error, because a
    folder on one machine does not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ionframe-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, for plans that read it several times. It is kept as compressed Parquet: a
    checkpoint holds each row as it lies in memory, several times as large."""
    path = scratch_path(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
