"""Operational analytics, ingest and streaming-shaped queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scores
from ..operators import evaluation, ingest, ordered, providers, retrieval
from .common import NOW, table


@query("quality_overview", "SELECT count(*) AS total, count(CASE WHEN value > 5 THEN value END) AS scored, round(coalesce(avg(CASE WHEN value > 5 THEN value END), 0), 6) AS mean_quality, count(*) FILTER (WHERE event_type = 'view') AS cache_hits, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def quality_overview(spark, sf_dir):
    """A01."""
    log = table(spark, sf_dir, "events").selectExpr("CASE WHEN value > 5 THEN value END AS quality", "event_type = 'view' AS cached", "CASE WHEN event_type = 'error' THEN 1 END AS error")
    return evaluation.quality_overview(log)


@query("daily_trend", "SELECT CAST(ts AS DATE) AS day, count(*) AS requests, round(avg(value), 6) AS mean_value, round(sum(value), 4) AS total_value FROM events GROUP BY 1")
def daily_trend(spark, sf_dir):
    """A02, K30."""
    return evaluation.daily_trend(table(spark, sf_dir, "events"), "ts", "value")


@query("usage_rollup", "SELECT CAST(ts AS DATE) AS day, user_id, event_type AS endpoint, count(*) AS requests, sum(CAST(value > 100 AS INT)) AS errors FROM events GROUP BY 1, 2, 3")
def usage_rollup(spark, sf_dir):
    """Requests and errors by day, key and endpoint."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id", F.col("event_type").alias("endpoint")).agg(F.count("*").alias("requests"), F.sum((F.col("value") > 100).cast("int")).alias("errors"))


@query("quota_check", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def quota_check(spark, sf_dir):
    """keys over their daily quota."""
    return evaluation.over_quota(table(spark, sf_dir, "events"), "user_id", "ts", 3)


@query("query_quality", """WITH q AS (SELECT user_id, count(*) AS n, min(event_id) % 12000 - 100 AS ms, list(value / 200) AS rel, list(CASE WHEN event_id % 3 > 0 THEN event_type END) AS doms, max(CASE WHEN event_id % 97 = 0 THEN 'x' END) AS err FROM events GROUP BY 1),
p AS (SELECT user_id, err, ms, least(n / 3, 1.0) AS coverage, greatest(0.0, least(1.0, list_avg(rel))) AS relevance, CASE WHEN len(list_filter(doms, lambda d: d IS NOT NULL)) > 0 THEN list_unique(doms) / len(list_filter(doms, lambda d: d IS NOT NULL)) ELSE 1.0 END AS dedup_ratio FROM q)
SELECT user_id, CASE WHEN err IS NULL THEN round(0.30 * coverage + 0.30 * relevance + 0.25 * CASE WHEN ms <= 0 THEN 1.0 WHEN ms >= 10000 THEN 0.0 ELSE 1 - ms / 10000 END + 0.15 * dedup_ratio, 4) ELSE 0.0 END AS quality, CASE WHEN err IS NULL THEN round(coverage, 4) ELSE 0.0 END AS coverage, CASE WHEN err IS NULL THEN round(relevance, 4) ELSE 0.0 END AS relevance, CASE WHEN err IS NULL THEN round(dedup_ratio, 4) ELSE 0.0 END AS dedup_ratio FROM p""")
def query_quality(spark, sf_dir):
    """A user's events as the results of one query."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.expr("min(event_id) % 12000 - 100").alias("ms"), F.expr("collect_list(value / 200)").alias("rel"), F.expr("collect_list(CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END)").alias("doms"), F.expr("max(CASE WHEN event_id % 97 = 0 THEN 'x' END)").alias("err"))
    return e.select("user_id", *[c.alias(k) for k, c in evaluation.query_quality(F.col("n"), F.col("ms"), F.col("rel"), F.col("doms"), F.col("err")).items()])


@query("latency_summary", "SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    """A18, M19."""
    return evaluation.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


_OUTCOME = "CASE event_id % 10 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' ELSE 'ok' END"
_CALLS = "SELECT event_type AS provider, event_id AS ts, CASE event_id % 12 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' WHEN 2 THEN 'captcha' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'empty' ELSE 'success' END AS outcome, value * 60 AS latency_ms, event_id % 9 AS result_count, event_id % 3 AS usable_result_count FROM events"


@query("provider_health", f"""WITH c AS ({_CALLS}),
s AS (SELECT provider, count(*) AS n, avg(CAST(outcome = 'success' AS INT)) AS success_rate, avg(CAST(outcome IN ('success', 'empty') AS INT)) AS ok_rate, avg(CAST(outcome = 'timeout' AS INT)) AS timeout_rate, avg(CAST(outcome = 'captcha' AS INT)) AS captcha_rate, avg(CAST(outcome = 'rate_limited' AS INT)) AS rate_limited_rate,
 avg(CAST(outcome = 'empty' AS INT)) AS empty_rate, avg(latency_ms) AS avg_latency_ms, avg(result_count) AS avg_result_count, avg(CAST(usable_result_count > 0 AS INT)) AS relevant_result_rate, list_sort(list(latency_ms)) AS v,
 avg(CASE outcome WHEN 'success' THEN 1.0 WHEN 'empty' THEN 0.5 WHEN 'timeout' THEN 0.1 WHEN 'rate_limited' THEN 0.15 WHEN 'captcha' THEN 0.0 ELSE 0.2 END) AS quality FROM c GROUP BY 1),
p AS (SELECT *, v[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50_latency_ms, v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1] AS p95_latency_ms FROM s),
h AS (SELECT *, least(1.0, 0.55 * quality + 0.20 * least(1.0, avg_result_count / 5) + 0.15 * CASE WHEN p50_latency_ms <= 2500 THEN 1.0 ELSE 2500 / p50_latency_ms END + 0.10 * (1 - captcha_rate)) AS health FROM p)
SELECT provider, n, round(success_rate, 6) AS success_rate, round(ok_rate, 6) AS ok_rate, round(timeout_rate, 6) AS timeout_rate, round(captcha_rate, 6) AS captcha_rate, round(rate_limited_rate, 6) AS rate_limited_rate, round(empty_rate, 6) AS empty_rate, round(avg_latency_ms, 6) AS avg_latency_ms, round(avg_result_count, 6) AS avg_result_count,
 round(relevant_result_rate, 6) AS relevant_result_rate, p50_latency_ms, p95_latency_ms, round(health, 6) AS health_score, CASE WHEN health >= 0.7 THEN 'healthy' WHEN health >= 0.3 THEN 'degraded' ELSE 'unhealthy' END AS status FROM h""")
def provider_health(spark, sf_dir):
    """A17, M24."""
    table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    return evaluation.provider_health(spark.sql(_CALLS.replace("FROM events", "FROM tessera_events")), "provider")


@query("engine_rates", f"""WITH c AS ({_CALLS}), g AS (SELECT provider, max(ts) FILTER (WHERE outcome IN ('success', 'empty')) AS good FROM c GROUP BY 1),
s AS (SELECT c.provider, count(*) AS n, avg(CAST(outcome NOT IN ('success', 'empty') AS INT)) AS failure_rate, avg(CAST(outcome = 'rate_limited' AS INT)) AS rate_429, avg(CAST(outcome = 'captcha' AS INT)) AS captcha_rate, count(*) FILTER (WHERE good IS NULL OR ts > good) AS consecutive_failures FROM c JOIN g ON c.provider = g.provider GROUP BY 1)
SELECT provider, n, round(failure_rate, 6) AS failure_rate, round(rate_429, 6) AS rate_429, round(captcha_rate, 6) AS captcha_rate, consecutive_failures, n >= 5 AND (failure_rate >= 0.5 OR rate_429 >= 0.3 OR captcha_rate >= 0.2 OR consecutive_failures >= 5) AS disabled FROM s""")
def engine_rates(spark, sf_dir):
    """A34, R06."""
    table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    return evaluation.engine_rates(spark.sql(_CALLS.replace("FROM events", "FROM tessera_events")), "provider")


@query("rolling_health", f"""WITH c AS (SELECT event_type AS provider, event_id, ts, CAST({_OUTCOME} = 'ok' AS INT) AS ok FROM events)
SELECT provider, event_id, count(*) OVER w AS window_n, round(avg(ok) OVER w, 9) AS ok_rate FROM c WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id ROWS 63 PRECEDING)""")
def rolling_health(spark, sf_dir):
    """The last 64 calls of each provider."""
    c = table(spark, sf_dir, "events").selectExpr("event_type AS provider", "event_id", "ts", f"CAST({_OUTCOME} = 'ok' AS int) AS ok")
    out = ordered.rolling(c, "provider", ["ts", "event_id"], F.date_trunc("hour", "ts"), 64, window_n=F.count(F.lit(1)), ok_rate=F.avg("ok"))
    return out.select("provider", "event_id", "window_n", F.round("ok_rate", 9).alias("ok_rate"))


@query("recent_queries", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def recent_queries(spark, sf_dir):
    """A top-k report."""
    return retrieval.recent(table(spark, sf_dir, "events"), 50, "event_id").select("event_id", "event_type", "user_id")


_MSG = "CASE event_id % 6 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'HTTP 429 Too Many Requests' WHEN 2 THEN 'captcha required' WHEN 3 THEN 'connection refused' WHEN 4 THEN NULL ELSE 'ok' END"


@query("outcome_classes", f"SELECT CASE WHEN m IS NULL OR m = 'ok' THEN 'ok' WHEN regexp_matches(lower(m), 'captcha|solvemedia|are you a robot|unusual traffic') THEN 'captcha' WHEN regexp_matches(lower(m), 'rate.?limit|too many requests|429') THEN 'rate_limited' WHEN regexp_matches(lower(m), 'time.?out|timed out|deadline exceeded') THEN 'timeout' ELSE 'error' END AS outcome, count(*) AS n FROM (SELECT {_MSG} AS m FROM events) GROUP BY 1")
def outcome_classes(spark, sf_dir):
    """F41, F42, X78."""
    m = F.expr(_MSG)
    out = F.when(m.isNull() | (m == "ok"), "ok").otherwise(providers.outcome_of(m))
    return table(spark, sf_dir, "events").select(out.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("change_rate", """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, CAST(o_orderstatus = 'F' AS DOUBLE) AS x FROM orders),
f AS (SELECT o_custkey, i, x * 0.3 AS e FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, f.e * 0.7 + o.x * 0.3 FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)
SELECT o_custkey AS domain_id, round(arg_max(e, i), 6) AS rate, round(168.0 - arg_max(e, i) * 167.0, 4) AS interval_h FROM f GROUP BY 1""")
def change_rate(spark, sf_dir):
    """An exponential average in order of time, and the recrawl interval."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("x")))).alias("seen"))
    rate = scores.ema(F.transform("seen", lambda s: s.x))
    return o.select(F.col("o_custkey").alias("domain_id"), F.round(rate, 6).alias("rate"), F.round(scores.recrawl_hours(rate), 4).alias("interval_h"))


_OLD = "SELECT o_orderkey AS id, md5(concat(o_orderstatus, o_orderpriority)) AS digest FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS id, md5(concat(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority)) AS digest FROM orders WHERE o_orderkey % 7 <> 0"


@query("change_classification", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT CASE WHEN o.digest IS NULL THEN 'new' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'changed' END AS change_type, count(*) AS n FROM n LEFT JOIN o USING (id) GROUP BY 1""")
def change_classification(spark, sf_dir):
    """K05, K04, A33."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tessera_orders")
    old, new = (spark.sql(q.replace("FROM orders", "FROM tessera_orders")) for q in (_OLD, _NEW))
    return ingest.change_classes(new, old, ["id"]).groupBy("change_type").agg(F.count("*").alias("n"))


@query("merge_upsert", """WITH t AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 3 <> 0),
s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Z' END AS status, o_totalprice + 1 AS price, o_orderdate + INTERVAL 1 DAY AS first_seen FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(t.id, s.id) AS id, coalesce(s.status, t.status) AS status, coalesce(s.price, t.price) AS price, coalesce(t.first_seen, s.first_seen) AS first_seen FROM t FULL JOIN s ON t.id = s.id""")
def merge_upsert(spark, sf_dir):
    """K02, K03, K10, K16, K19, K44."""
    o = table(spark, sf_dir, "orders")
    t = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "o_orderdate AS first_seen")
    s = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Z' END AS status", "o_totalprice + 1 AS price", "o_orderdate + INTERVAL 1 DAY AS first_seen")
    return ingest.merged(t, s, ["id"], keep_old=("first_seen",))


@query("delta_scan", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 1000)")
def delta_scan(spark, sf_dir):
    """Rows after a composite cursor."""
    return ingest.delta(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"), 1000).select("o_orderkey", "o_orderdate")


@query("reconcile", "WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 20), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 1) SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'canonical' WHEN b.id IS NULL THEN 'index' ELSE 'both' END AS side FROM a FULL JOIN b ON a.id = b.id) GROUP BY 1")
def reconcile(spark, sf_dir):
    """K24, K23, K28, K37, U04, J12, S44-S46."""
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 20").selectExpr("l_orderkey AS id")
    b = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 1").selectExpr("o_orderkey AS id")
    return ingest.reconciled(a, b, "id").groupBy("side").agg(F.count("*").alias("n"))


_F_OLD = "SELECT concat('u', o_custkey) AS url, CAST(max(o_orderkey % 10) AS DOUBLE) AS priority, min(o_orderkey % 6) AS depth, min(o_orderdate) AS next_crawl, CASE max(o_orderkey) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'leased' END AS status FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey"
_F_NEW = "SELECT concat('u', o_custkey) AS url, CAST(max(o_orderkey % 12) AS DOUBLE) AS priority, min(o_orderkey % 5) AS depth, max(o_orderdate) AS next_crawl FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey"


@query("frontier_upsert", f"""WITH o AS ({_F_OLD}), n AS ({_F_NEW}) SELECT coalesce(o.url, n.url) AS url, greatest(coalesce(o.priority, n.priority), coalesce(n.priority, o.priority)) AS priority, least(coalesce(o.depth, n.depth), coalesce(n.depth, o.depth)) AS depth, least(coalesce(o.next_crawl, n.next_crawl), coalesce(n.next_crawl, o.next_crawl)) AS next_crawl,
CASE WHEN o.status IS NULL THEN 'pending' WHEN o.status IN ('done', 'failed') AND n.url IS NOT NULL THEN 'pending' ELSE o.status END AS status FROM o FULL JOIN n ON o.url = n.url""")
def frontier_upsert(spark, sf_dir):
    """K13, K14, S47."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tessera_orders")
    old, new = (spark.sql(q.replace("FROM orders", "FROM tessera_orders")) for q in (_F_OLD, _F_NEW))
    return ingest.frontier(old, new.withColumn("status", F.lit(None).cast("string")))


@query("frontier_pop", f"WITH o AS ({_F_OLD}) SELECT url, priority, next_crawl FROM o WHERE status = 'pending' AND next_crawl <= {NOW} ORDER BY priority DESC, next_crawl, url LIMIT 25")
def frontier_pop(spark, sf_dir):
    """The batch that is due, a top-k report."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tessera_orders")
    return ingest.due(spark.sql(_F_OLD.replace("FROM orders", "FROM tessera_orders")), F.expr(NOW), 25).select("url", "priority", "next_crawl")


@query("crawl_politeness", """WITH r AS (SELECT event_type AS domain, event_id AS request_id, CAST(epoch(ts) AS DOUBLE) AS ts_s, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts), event_id) - 1 AS i FROM events)
SELECT domain, request_id, round(max(ts_s - i * 600.0) OVER (PARTITION BY domain ORDER BY ts_s, request_id ROWS UNBOUNDED PRECEDING) + i * 600.0, 3) AS start_s FROM r""")
def crawl_politeness(spark, sf_dir):
    """Spacing of the requests to a domain."""
    r = table(spark, sf_dir, "events").selectExpr("event_type AS domain", "event_id AS request_id", "unix_micros(CAST(ts AS timestamp)) / 1000000D AS ts_s")
    return ingest.polite_schedule(r, 600.0).select("domain", "request_id", F.round("start_s", 3).alias("start_s"))


@query("sessions", """WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS turns, round(sum(value), 4) AS value FROM s GROUP BY user_id, n""")
def sessions(spark, sf_dir):
    """Sessions that end after six quiet hours, by Spark's session window."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("turns"), F.round(F.sum("value"), 4).alias("value"))
    return s.drop("session_window")


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """A02 in hours, as the stream aggregates them."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").start.cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


_V = "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name END AS raw_name, CASE WHEN c_custkey % 34 = 0 THEN '' ELSE concat('x', c_custkey) END AS external_id, CASE WHEN c_custkey % 23 > 0 THEN {now} END AS observed_at, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 100 - 5 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 200 AS DOUBLE) END AS lon, CASE WHEN c_custkey % 5 = 0 THEN '12' ELSE concat('0', 901000000 + c_custkey) END AS raw_phone, CASE WHEN c_custkey % 7 = 0 THEN 'https:///x' ELSE 'Example.com/a' END AS raw_website, c_custkey % 101 = 0 AS parse_error FROM customer".format(now=NOW)


@query("validate_dlq", f"""WITH v AS ({_V}), r AS (SELECT id, CASE WHEN parse_error THEN ['parse_error'] ELSE list_filter([CASE WHEN trim(raw_name) = '' THEN 'missing_name' END, CASE WHEN trim(raw_name) = '' AND trim(external_id) = '' THEN 'missing_identity' END, CASE WHEN observed_at IS NULL THEN 'missing_observed_at' END,
CASE WHEN lat IS NULL AND lon IS NULL THEN NULL WHEN lat IS NULL OR lon IS NULL THEN 'partial_coordinates' WHEN lat NOT BETWEEN -90 AND 90 THEN 'invalid_latitude' WHEN lon NOT BETWEEN -180 AND 180 THEN 'invalid_longitude' WHEN NOT (lat BETWEEN 6 AND 24 AND lon BETWEEN 100 AND 119.5) THEN 'coords_outside_vietnam' END,
CASE WHEN raw_phone = '12' THEN 'implausible_phone' END, CASE WHEN raw_website = 'https:///x' THEN 'malformed_website' END], lambda x: x IS NOT NULL) END AS reasons FROM v)
SELECT id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""")
def validate_dlq(spark, sf_dir):
    """Rejected records with all reasons."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    _, rejected = ingest.validated(spark.sql(_V.replace("FROM customer", "FROM tessera_customer")))
    return rejected.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("recrawl_plan", "SELECT p_partkey AS id, round(168.0 - (p_size / 50.0) * 167.0, 6) AS interval_h, least((p_partkey % 90 + 1) * 10, 720) AS backoff_min FROM part")
def recrawl_plan(spark, sf_dir):
    """D10, D11, D12."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size / 50D AS change_rate", "p_partkey % 90 AS failures")
    return ingest.recrawl(p).select("id", F.round("interval_h", 6).alias("interval_h"), "backoff_min")
