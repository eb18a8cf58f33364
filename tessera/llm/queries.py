"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, filter_audit, line_dedup, mixing, pii, price_band, quality_gbdt, quality_rules, sharding, simhash, substring_dedup
from .runtime import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op5_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed_lines", exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("repeats", "serves", "text_hash")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_band.near_prices(spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii, op2_bpe, op3_simhash, op4_exact_dedup, op5_quality_gbdt, op6_line_dedup, op7_substring_dedup, op8_sharding, op9_quality_rules, op10_mixing,
        op11_filter_audit, op12_price_band, op13_chat_format,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_substring_dedup": substring_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE, "op12_price_band": price_band.ORACLE}
