"""A training corpus from the documents table: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, quality_rules, simhash
from tessera.llm.queries import RANKS
from tessera.llm.runtime import documents, release, tables_written, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts or the classifier reject go."""
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier are cut out of the texts; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS long) AS n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of similar texts (five-word shingles, about 0.8 or more) stays."""
    return simhash.dedup_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix."""
    return bpe.tokenized(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality rules", rules), ("line dedup", lines), ("SimHash near-dedup", near), ("mixing", mixture), ("byte-level BPE", tokens)]

#: SQL expresses neither the classifier nor XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage wrote on its way goes once its result is there."""
    docs, mark = documents(spark, sf_dir), tables_written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            release(spark, since=mark, keep=1)
    return docs
