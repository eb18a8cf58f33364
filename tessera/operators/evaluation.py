"""Retrieval quality and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores


def ranking_metrics(runs: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Runs (query_id, key, pos from 1), expected (query_id, key): for each query with an
    expectation ndcg, mrr, recall, precision (over k), precision_retrieved (over what was retrieved)."""
    want = expected.select("query_id", "key").distinct()
    sizes = want.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    flagged = runs.where(F.col("pos") <= k).join(want.withColumn("rel", F.lit(1)), ["query_id", "key"], "left")
    gain = F.when(F.col("rel") == 1, 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)
    got = flagged.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("pos"))).alias("first"), F.countDistinct(F.when(F.col("rel") == 1, F.col("key"))).alias("found"), F.count("rel").alias("hits"), F.count("*").alias("retrieved"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(got, "query_id", "left").select(
        "query_id", F.round(zero(F.col("dcg") / ideal), 9).alias("ndcg"), F.round(zero(1 / F.col("first")), 9).alias("mrr"), F.round(zero(F.col("found") / F.col("n_expected")), 9).alias("recall"),
        F.round(zero(F.col("hits") / k), 9).alias("precision"), F.round(zero(F.col("hits") / F.col("retrieved")), 9).alias("precision_retrieved"),
    )


def ranked_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each distinct value of a group with __upto, how many rows have it or less, and __n, how many there are: a
    histogram, so that no row or task holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    over = Window.partitionBy(*by)
    return counts.withColumn("__upto", F.sum("__c").over(over.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(over))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    at = lambda p: F.min(F.when(F.col("__upto") >= F.ceil(F.lit(p) * F.col("__n") - 1e-9), F.col(value)))
    ranks = ranked_values(df, by, value).groupBy(*by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean")).join(ranks, by, "left")


#: What a call's outcome is worth. Fixed values.
OUTCOME_QUALITY = {"success": 1.0, "empty": 0.5, "timeout": 0.1, "rate_limited": 0.15, "captcha": 0.0, "error": 0.2}


def rounded_index_percentiles(df: DataFrame, by: str, value: str, ps: dict[str, float]) -> DataFrame:
    """M24 without a list of all values: each distinct value's count, then running counts; the element at
    p x (n - 1), rounded half to even. Memory is a row a distinct value, over all tasks of a group's sort."""
    run = ranked_values(df, [by], value)
    at = lambda p: F.min(F.when(F.col("__upto") > F.bround(F.lit(p) * (F.col("__n") - 1)), F.col(value)))
    return run.groupBy(by).agg(*[at(p).alias(name) for name, p in ps.items()])


def provider_health(calls: DataFrame, by: str, target_ms: float = 2500.0, enough_results: float = 5.0) -> DataFrame:
    """Calls (by, outcome, latency_ms, result_count, usable_result_count): shares of outcomes, mean latency, p50 and
    p95 by rounded index, a health score and its status (healthy from .7, degraded from .3)."""
    rate = lambda *v: F.avg(F.col("outcome").isin(*v).cast("double"))
    stats = calls.groupBy(by).agg(
        F.count("*").alias("n"), rate("success").alias("success_rate"), rate("success", "empty").alias("ok_rate"), rate("timeout").alias("timeout_rate"), rate("captcha").alias("captcha_rate"), rate("rate_limited").alias("rate_limited_rate"), rate("empty").alias("empty_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.avg("result_count").alias("avg_result_count"), F.avg((F.col("usable_result_count") > 0).cast("double")).alias("relevant_result_rate"), F.avg(scores.lookup(OUTCOME_QUALITY, F.col("outcome"), 0.2)).alias("__quality"),
    )
    both = stats.join(rounded_index_percentiles(calls, by, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}), by)
    p50 = F.col("p50_latency_ms")
    speed = F.when((p50 <= target_ms) | (p50 <= 0), 1.0).otherwise(F.lit(target_ms) / p50)
    health = scores.clamp(0.55 * F.col("__quality") + 0.20 * F.least(F.lit(1.0), F.col("avg_result_count") / enough_results) + 0.15 * speed + 0.10 * (1 - F.col("captcha_rate")))
    both = both.withColumn("health_score", health)
    status = F.when(F.col("health_score") >= 0.7, "healthy").when(F.col("health_score") >= 0.3, "degraded").otherwise("unhealthy")
    shares = ("success_rate", "ok_rate", "timeout_rate", "captcha_rate", "rate_limited_rate", "empty_rate", "avg_latency_ms", "avg_result_count", "relevant_result_rate")
    return both.select(by, "n", *[F.round(c, 6).alias(c) for c in shares], "p50_latency_ms", "p95_latency_ms", F.round("health_score", 6).alias("health_score"), status.alias("status"))


def engine_rates(calls: DataFrame, by: str, least: int = 5) -> DataFrame:
    """Calls (by, ts, outcome): failure, 429 and captcha rates, failures in a row at the end, and whether the
    engine is to be disabled: from `least` calls on, at .5, .3 and .2 of them or five failures in a row."""
    failed = ~F.col("outcome").isin("success", "empty")
    last_good = F.max(F.when(~failed, F.col("ts")))
    per = calls.groupBy(by).agg(F.count("*").alias("n"), F.avg(failed.cast("double")).alias("failure_rate"), F.avg((F.col("outcome") == "rate_limited").cast("double")).alias("rate_429"), F.avg((F.col("outcome") == "captcha").cast("double")).alias("captcha_rate"), last_good.alias("__good"))
    streak = calls.join(per.select(by, "__good"), by).where(F.col("__good").isNull() | (F.col("ts") > F.col("__good"))).groupBy(by).agg(F.count("*").alias("consecutive_failures"))
    out = per.join(streak, by, "left").fillna(0, ["consecutive_failures"])
    disable = (F.col("n") >= least) & ((F.col("failure_rate") >= 0.5) | (F.col("rate_429") >= 0.3) | (F.col("captcha_rate") >= 0.2) | (F.col("consecutive_failures") >= 5))
    return out.select(by, "n", *[F.round(c, 6).alias(c) for c in ("failure_rate", "rate_429", "captcha_rate")], "consecutive_failures", disable.alias("disabled"))


def quality_overview(log: DataFrame) -> DataFrame:
    """Log (quality, cached, error)."""
    return log.agg(F.count("*").alias("total"), F.count("quality").alias("scored"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_quality"), F.count_if("cached").alias("cache_hits"), F.count("error").alias("errors"))


def daily_trend(log: DataFrame, ts: str, value: str) -> DataFrame:
    """By day."""
    return log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("requests"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.sum(value), 4).alias("total_value"))


def query_quality(results: Column, latency_ms: Column, relevance: Column, domains: Column, error: Column) -> dict[str, Column]:
    """Quality and its parts. relevance: array of scores; domains: array of names. .30 coverage (three results
    suffice) + .30 mean relevance + .25 latency (0 from 10 s on, 1 up to 0) + .15 unique domains; all 0 on an error."""
    named = F.filter(domains, lambda d: d.isNotNull() & (d != ""))
    parts = {
        "coverage": F.when(results > 0, F.least(results / 3, F.lit(1.0))).otherwise(0.0),
        "relevance": F.when(F.size(relevance) > 0, scores.clamp(F.aggregate(relevance, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(relevance))).otherwise(0.0),
        "dedup_ratio": F.when(F.size(named) > 0, F.size(F.array_distinct(named)) / F.size(named)).otherwise(1.0),
    }
    speed = F.when(latency_ms <= 0, 1.0).when(latency_ms >= 10_000, 0.0).otherwise(1 - latency_ms / 10_000)
    quality = scores.clamp(0.30 * parts["coverage"] + 0.30 * parts["relevance"] + 0.25 * speed + 0.15 * parts["dedup_ratio"])
    bad = error.isNotNull() & (error != "")
    return {k: F.when(bad, 0.0).otherwise(F.round(v, 4)) for k, v in ({"quality": quality} | parts).items()}


def domain_jaccard(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """Jaccard of the distinct items that two reports have for a key; both must have the key."""
    left, right = a.select(by, item).distinct().withColumn("l", F.lit(1)), b.select(by, item).distinct().withColumn("r", F.lit(1))
    both = left.join(right, [by, item], "full_outer")
    out = both.groupBy(by).agg(F.count("l").alias("nl"), F.count("r").alias("nr"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count("*").alias("either"))
    return out.where("nl > 0 and nr > 0").select(by, "common", F.round(F.col("common") / F.col("either"), 9).alias("jaccard"), F.round(F.col("common") / F.col("nl"), 9).alias("recall"))


def source_diversity(df: DataFrame, by: str, item: str) -> DataFrame:
    """Distinct over all non-empty items."""
    full = df.where(F.col(item).isNotNull() & (F.col(item) != ""))
    return full.groupBy(by).agg(F.round(F.countDistinct(item) / F.count("*"), 9).alias("diversity"))


def report_diff(new: DataFrame, base: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """Two reports (metric, value): the shared metrics and +, - or = by each one's direction."""
    both = new.withColumnRenamed("value", "new").join(base.withColumnRenamed("value", "base"), "metric")
    sign = F.when(F.col("metric").isin(*lower_is_better), -1).otherwise(1) * (F.col("new") - F.col("base"))
    return both.withColumn("verdict", F.when(sign > 1e-12, "+").when(sign < -1e-12, "-").otherwise("="))


def over_quota(calls: DataFrame, key: str, ts: str, quota: int) -> DataFrame:
    """keys and days with `quota` calls or more."""
    return calls.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("requests")).where(F.col("requests") >= quota)


def run_counters(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (change_type) of a run as counters: seen, new, changed, unchanged, invalid, failed."""
    kinds = ("new", "changed", "unchanged", "invalid", "failed")
    return changes.groupBy(*(by or [])).agg(F.count("*").alias("seen"), *[F.count_if(F.col("change_type") == k).alias(k) for k in kinds])


def mean_report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The number of queries and the mean of each metric over those that have it."""
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def authority_mean(rows: DataFrame, by: str, domain: str, scorer) -> DataFrame:
    """The mean authority of a group's distinct domains; 0 without any."""
    from ..functions import urls

    each = rows.select(by, urls.normalize_domain(F.col(domain)).alias("d")).where("d <> ''").distinct()
    found = each.groupBy(by).agg(F.round(F.avg(scorer(F.col("d"))), 4).alias("authority"))
    return rows.select(by).distinct().join(found, by, "left").fillna(0.0, ["authority"])


def shadow_summary(shadow: DataFrame) -> DataFrame:
    """Shadow runs (recall, overlap, latency_ms): how many and their means."""
    return shadow.agg(F.count("*").alias("runs"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in ("recall", "overlap", "latency_ms")])


def answer_report(answers: DataFrame) -> DataFrame:
    """Answers (answer, facts, cited, expected, citations, sources): every answer's metrics, 3 places; null where
    there is nothing to measure."""
    from . import answers as a

    c = F.col
    three = {
        "fact_coverage": a.fact_coverage(c("answer"), c("facts")), "citation_precision": a.citation_precision(c("cited"), c("expected")), "citation_recall": a.citation_recall(c("cited"), c("expected")), "source_coverage": a.cited_source_coverage(c("cited"), c("sources")),
        "unsupported_rate": a.unsupported_rate(c("citations")), "quote_rate": a.quote_rate(c("citations")),
    }
    return answers.select(*[x for x in answers.columns if x not in ("answer", "facts", "cited", "expected", "citations", "sources")], *[F.round(v, 3).alias(k) for k, v in three.items()])
