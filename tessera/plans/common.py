"""Tables of the domain made of the standard ones, in Spark and in SQL.

hits: search hits of provider lanes (events); places and records (supplier, customer) on a grid of
coordinates; calls: provider calls (events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, provider, key, domain, pos, score: one hit a query, lane and key, the best value's."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.expr("user_id % 97").alias("query_id"), F.col("event_type").alias("provider"), F.expr("event_id % 41").alias("key")).agg(F.max("value").alias("score"), F.min("event_id").alias("pos")).withColumn("domain", F.expr("concat('d', key % 7)"))


HITS = "hits AS (SELECT user_id % 97 AS query_id, event_type AS provider, event_id % 41 AS key, max(value) AS score, min(event_id) AS pos, concat('d', event_id % 41 % 7) AS domain FROM events GROUP BY 1, 2, 3)"

_LAT, _LON = "8.5 + ({k} * 7919 % 14000) / 1000.0", "102.5 + ({k} * 104729 % 6500) / 1000.0"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS place_id", "s_name AS name", "concat('cat', s_nationkey % 5) AS category", f"CAST({_LAT.format(k='s_suppkey')} AS double) AS lat", f"CAST({_LON.format(k='s_suppkey')} AS double) AS lon", "s_nationkey AS admin_unit_id",
        "CASE WHEN s_suppkey % 11 = 0 THEN 'permanently_closed' WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'open' END AS status", "CAST((s_suppkey % 10) / 10.0 AS double) AS confidence", "CAST((s_suppkey % 7) / 7.0 AS double) AS freshness",
        "CASE WHEN s_suppkey % 4 > 0 THEN CAST((s_suppkey % 50) / 10.0 AS double) END AS rating", "s_suppkey * 13 % 900 AS review_count", "s_suppkey % 6 AS source_count",
    )


PLACES = f"""places AS (SELECT s_suppkey AS place_id, s_name AS name, concat('cat', s_nationkey % 5) AS category, CAST({_LAT.format(k='s_suppkey')} AS double) AS lat, CAST({_LON.format(k='s_suppkey')} AS double) AS lon, s_nationkey AS admin_unit_id,
 CASE WHEN s_suppkey % 11 = 0 THEN 'permanently_closed' WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'open' END AS status, CAST((s_suppkey % 10) / 10.0 AS double) AS confidence, CAST((s_suppkey % 7) / 7.0 AS double) AS freshness,
 CASE WHEN s_suppkey % 4 > 0 THEN CAST((s_suppkey % 50) / 10.0 AS double) END AS rating, s_suppkey * 13 % 900 AS review_count, s_suppkey % 6 AS source_count FROM supplier)"""


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


SQL_WORDS = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"
