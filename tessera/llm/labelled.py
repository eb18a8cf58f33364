"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) leaves 0 when divided by 5 are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """doc_id, text, label of at most `most` labelled rows outside the held-out fold: the first by a seeded
    hash of doc_id. Rows without a label or id, and texts that are null, take no part; of several labels of
    a doc_id the smallest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("label"))
    chosen = known.where(~held_out("__id")).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(most)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `most` rows of two numbers: the bound is the parameter's
    return rows.join(F.broadcast(chosen), rows.doc_id == F.col("__id")).select("doc_id", "text", (F.col("label") == 1).cast("int").alias("label"))
