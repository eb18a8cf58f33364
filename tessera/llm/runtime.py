"""Session helpers shared by the operators: shared-folder tables and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once; a longer single text is taken alone.
CHUNK_BYTES = 1 << 20
#: Separators of words in every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir().rstrip("/")


_tables: list[tuple[str, str]] = []  # application and path of each table written


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, so a lost
    executor costs a reread and several consumers share one computation."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/tessera-{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((app, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """A mark for release(): how many tables there are so far."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that written() has left for this application since a mark, but for the last `keep`.
    Only for tables whose readers have run."""
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    for one, path in _tables[since : len(_tables) - keep]:
        if one == app:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since : len(_tables) - keep]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def salt_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(n)).cast("int")
