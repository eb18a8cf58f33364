"""Exact dedup: skew-safe combining by full content, without Python on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE, salt_of, text_of, written

SALTS = 64
HOT_SHARE = 2000
HOT_LEAST = 50


def normal_text(text: Column) -> Column:
    """Each run of spaces and U+0009 to U+000D as one space."""
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_groups(docs: DataFrame, digest=sha256, salts: int = SALTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the smallest doc_id with an equal text),
    group_size, kept (doc_id = keep_id), text_sha256. Texts are equal if they agree after
    normal_text; null counts as empty.

    Digests that hold more than a hot_share-th of the rows (hot_share of them at most, so their list may
    be broadcast) are salted, the others have salt 0. 1. Equal texts of a task combine before the exchange
    (partial aggregation on digest, salt and whole text); 2. the salted groups combine; 3. the winners of
    hot groups, `salts` for a text at most, combine. Texts are compared in full at each step, so a digest
    that collides can't merge groups. The way back goes over (digest, salt), so no join key holds more than
    a salt's share of a hot group; only if a digest has several texts does the text travel there as well.

    A null doc_id belongs to its group, has kept false, and is never keep_id unless all are null.
    Rows that repeat the kept doc_id are all kept. Other columns of docs are ignored.
    """
    plain = docs.select(docs.doc_id.cast("long").alias("doc_id"), normal_text(text_of(docs)).alias("body"))
    keyed = plain.select("doc_id", digest(F.col("body")).alias("digest"), "body")
    ids = written(keyed.select("doc_id", "digest"), "digests")
    rows = ids.count()
    hot = ids.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_LEAST, rows // hot_share)).select("digest", F.lit(True).alias("hot"))
    hot = F.broadcast(written(hot, "hot"))  # fewer than hot_share rows, as their counts add up to at most `rows`

    def salted(df: DataFrame) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), salt_of("doc_id", salts)).otherwise(F.lit(0)))

    groups = salted(keyed).groupBy("digest", "salt", "hot", "body").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    parts = written(groups.select("digest", "salt", "hot", "least", "n", F.when(F.col("hot"), F.col("body")).alias("body")), "groups")
    hot_whole = parts.where("hot").groupBy("digest", "body").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    cold = parts.where("hot is null").select("digest", F.col("least").alias("keep_id"), F.col("n").alias("group_size"))
    whole = cold.unionByName(hot_whole.drop("body"))
    several = whole.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    several = written(several, "classes")
    clear = parts.select("digest", "salt").distinct().join(several.where("texts = 1").drop("texts"), "digest")
    out = salted(ids).join(clear, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "digest")
    clashes = several.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        theirs = keyed.join(clashes, "digest", "left_semi")
        classes = theirs.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(theirs.join(classes, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
