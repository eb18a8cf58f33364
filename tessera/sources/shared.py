"""The folder that driver and executors share, and tables written there on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call; nothing is in it yet."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read back: its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """The table of an iteration's latest round: each next() writes a round, which may read the one before, and then deletes that."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._last = spark, name, None

    def next(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, self.name)
        df.write.parquet(path)
        if self._last:
            delete(self.spark, self._last)
        self._last = path
        return self.spark.read.schema(df.schema).parquet(path)
