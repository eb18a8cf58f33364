"""Running values along long groups, in buckets, so that a hot group isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positioned(df: DataFrame, by: str, order: list[str], bucket: Column) -> DataFrame:
    """df with __bucket and __pos, the place from 0 of each row in its group. `bucket` must not fall along `order` and
    rows that tie in `order` must share one. Rows are numbered inside (group, bucket); buckets are offset by their counts."""
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = sizes.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order)) - 1
    return rows.withColumn("__in", inside).join(offsets, [by, "__bucket"]).withColumn("__pos", F.col("__off") + F.col("__in")).drop("__off", "__in")


def rolling(df: DataFrame, by: str, order: list[str], bucket: Column, n: int, block: int = 4096, **values: Column) -> DataFrame:
    """Values over the last n rows of the group (n < block). Rows go to blocks of `block` places; the last n - 1 of
    each block are lent to the next one as well."""
    rows = positioned(df, by, order, bucket).withColumn("__block", F.floor(F.col("__pos") / block))
    lent = F.when(F.col("__pos") % block >= block - (n - 1), F.array(F.col("__block"), F.col("__block") + 1)).otherwise(F.array("__block"))
    rows = rows.withColumn("__in", F.explode(lent))
    over = Window.partitionBy(by, "__in").orderBy("__pos").rowsBetween(-(n - 1), 0)
    rows = rows.withColumns({name: v.over(over) for name, v in values.items()})
    return rows.where(F.col("__in") == F.col("__block")).drop("__bucket", "__block", "__in", "__pos")


def running_max(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """positioned() rows with the greatest `value` up to each: within its bucket, and of the buckets before."""
    rows = df.withColumn("__v", value)
    tops = rows.groupBy(by, "__bucket").agg(F.max("__v").alias("__top"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(by, "__bucket", F.max("__top").over(before).alias("__before"))
    here = F.max("__v").over(Window.partitionBy(by, "__bucket").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__here", here).join(tops, [by, "__bucket"]).withColumn(name, F.greatest("__here", "__before")).drop("__v", "__here", "__before")
