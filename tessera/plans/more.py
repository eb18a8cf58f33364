"""Reranking, crawl, payload and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import payload, scores, text, urls
from ..operators import answers, crawl, rerank
from ..sources.shared import written
from .common import HITS, NOW, hits, table


@query("source_composites", f"""WITH x AS (SELECT o_orderkey AS key, (o_custkey % 100) / 100.0 AS rel, (o_custkey % 10) / 10.0 AS auth, greatest(0, 0) AS z, (o_orderkey % 15) / 10.0 AS engine, epoch({NOW} - o_orderdate) / 86400.0 AS age, CASE o_orderkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'news' ELSE '' END AS lane FROM orders),
f AS (SELECT *, CASE WHEN age < 0 THEN 0.0 WHEN lane = 'legal' THEN round(0.3 * greatest(0.0, 1 - age / 7300.0), 4) WHEN lane = 'news' THEN round(0.3 * greatest(0.0, 1 - age / 4.0), 4) WHEN age < 1 THEN 0.3 WHEN age < 7 THEN 0.15 ELSE 0.0 END AS fresh FROM x)
SELECT key, fresh, round((0.35 * rel + 0.35 * auth + 0.15 * fresh + 0.15 * least(engine, 1.0)) * CASE WHEN auth < 0.25 THEN 0.5 ELSE 1.0 END, 6) AS score FROM f""")
def source_composites(spark, sf_dir):
    """W28, D02."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_orderdate", "(o_custkey % 100) / 100D AS rel", "(o_custkey % 10) / 10D AS auth", "(o_orderkey % 15) / 10D AS engine", "CASE o_orderkey % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'news' ELSE '' END AS lane")
    o = o.withColumn("fresh", rerank.freshness_bonus(F.col("o_orderdate"), F.expr(NOW), F.col("lane")))
    return o.select("key", "fresh", F.round(rerank.composite(F.col("rel"), F.col("auth"), F.col("fresh"), F.col("engine")), 6).alias("score"))


@query("age_scores", f"SELECT o_orderkey AS key, CASE WHEN a <= 1 THEN 0.95 WHEN a <= 7 THEN 0.90 WHEN a <= 30 THEN 0.80 WHEN a <= 90 THEN 0.65 WHEN a <= 180 THEN 0.55 WHEN a <= 365 THEN 0.40 WHEN a <= 730 THEN 0.25 ELSE 0.10 END AS score FROM (SELECT o_orderkey, greatest(0.0, epoch(TIMESTAMP '1998-06-01' - o_orderdate) / 86400.0) AS a FROM orders)")
def age_scores(spark, sf_dir):
    """D05, D06."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), rerank.age_score(scores.age_days(F.col("o_orderdate"), F.expr("TIMESTAMP '1998-06-01 00:00:00'"))).alias("score"))


@query("recrawl_priorities", "SELECT p_partkey AS id, round(0.30 * p_size / 50 + 0.20 * ((p_partkey % 10) / 10.0) + 0.20 * ((p_partkey % 7) / 7.0) + 0.15 * CASE p_partkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.0 END + 0.10 * ((p_partkey % 4) / 4.0) + 0.05 * least((p_partkey * 100 % 100000) / 86400, 1.0), 9) AS priority FROM part")
def recrawl_priorities(spark, sf_dir):
    """D11."""
    e = F.expr
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(rerank.recrawl_priority(e("p_size / 50D"), e("(p_partkey % 10) / 10D"), e("(p_partkey % 7) / 7D"), e("CASE p_partkey % 3 WHEN 0 THEN 'realtime' WHEN 1 THEN 'slow' ELSE 'x' END"), e("(p_partkey % 4) / 4D"), e("p_partkey * 100 % 100000")), 9).alias("priority"))


@query("heuristic_rank", f"WITH {HITS} SELECT query_id, key, provider, round(0.30 * ((key % 10) / 10.0) + 0.25 * ((pos % 8) / 8.0) + 0.20 * ((pos % 5) / 5.0) + 0.15 * ((key % 3) / 3.0) + 0.10 * least(count(*) OVER (PARTITION BY query_id, domain) / 5, 1.0), 6) AS heuristic FROM hits")
def heuristic_rank(spark, sf_dir):
    """W34, M22."""
    h = hits(spark, sf_dir).selectExpr("query_id", "key", "provider", "domain", "(key % 10) / 10D AS relevance", "(pos % 8) / 8D AS authority", "(pos % 5) / 5D AS fresh", "(key % 3) / 3D AS matched")
    return rerank.heuristic_rank(h).select("query_id", "key", "provider", F.round("heuristic", 6).alias("heuristic"))


@query("soft_filter", f"WITH {HITS} SELECT query_id, key, provider FROM hits QUALIFY key % 37 = 0 OR NOT max(key % 37 = 0) OVER (PARTITION BY query_id)")
def soft_filter(spark, sf_dir):
    """F44."""
    return rerank.soft_filter(hits(spark, sf_dir), "query_id", F.expr("key % 37 = 0")).select("query_id", "key", "provider")


@query("extraction_quality", r"SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round(0.6 * least(len(regexp_extract_all(text, '[^\x09-\x0D ]+')) / 400, 1.0) + 0.4 * least(length(text) / greatest(n_chars * 5, 1) / 0.30, 1.0), 3) END AS quality FROM documents")
def extraction_quality(spark, sf_dir):
    """M12, F13."""
    return table(spark, sf_dir, "documents").select("doc_id", rerank.extraction_quality(F.col("text"), F.col("n_chars") * 5).alias("quality"))


_PAYLOADS = """SELECT click_id AS id, CASE WHEN click_id % 13 = 0 THEN concat('not json ', click_id) ELSE concat('{"review_rating": ', CASE WHEN click_id % 17 = 0 THEN 'true' WHEN click_id % 2 = 0 THEN concat(click_id % 70 // 10, '.', click_id % 10) ELSE concat('"', click_id % 7, '.0"') END,
', "review_count": ', CASE click_id % 4 WHEN 0 THEN concat(click_id % 5000) WHEN 1 THEN concat('"', 1 + click_id % 9, ',', lpad(CAST(coalesce(client_id, 0) % 1000 AS string), 3, '0'), '"') WHEN 2 THEN '"12,34"' ELSE concat(click_id % 50, '.5') END,
', "price_range": "', coalesce(concat(' ', kind, ' '), ' '), '", "images": [', CASE WHEN click_id % 3 = 0 THEN concat('"http://a/', coalesce(client_id, 0), '", {"u": ["https://b/', click_id, '"]}, "http://a/', coalesce(client_id, 0), '", "ftp://x"') ELSE '' END, ']}') END AS payload FROM clicks"""


def payload_fields(rows):
    """rows (id, payload): the fields beyond the common ones, as strings where they are decimals."""
    p = F.col("payload")
    return rows.select("id", payload.rating(p).cast("string").alias("rating"), payload.review_count(p).alias("reviews"), payload.price_level(p).alias("price"), F.array_join(payload.image_urls(p), " ").alias("images"))


@query("rich_fields", """SELECT click_id AS id, CASE WHEN ok AND click_id % 17 > 0 THEN CASE WHEN click_id % 2 = 0 THEN CASE WHEN click_id % 70 <= 50 THEN concat(click_id % 70 // 10, '.', click_id % 10) END WHEN click_id % 7 <= 5 THEN concat(click_id % 7, '.0') END END AS rating,
CASE WHEN ok THEN CASE click_id % 4 WHEN 0 THEN click_id % 5000 WHEN 1 THEN (1 + click_id % 9) * 1000 + coalesce(client_id, 0) % 1000 END END AS reviews, CASE WHEN ok THEN kind END AS price, CASE WHEN ok AND click_id % 3 = 0 THEN concat('http://a/', coalesce(client_id, 0), ' https://b/', click_id) END AS images FROM (SELECT *, click_id % 13 > 0 AS ok FROM clicks)""")
def rich_fields(spark, sf_dir):
    """N01, N02."""
    table(spark, sf_dir, "clicks").createOrReplaceTempView("tessera_clicks")
    return payload_fields(spark.sql(_PAYLOADS.replace(" // ", " div ").replace("FROM clicks", "FROM tessera_clicks")))


_BODIES = ("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/4\nDisallow: /fr/$", "User-agent: Bot\nDisallow: /*.html$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /", "User-agent: *\nDisallow: /")
_HOSTS = r"SELECT page_id AS url_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"


@query("robots_verdicts", rf"""WITH r AS ({_HOSTS}) SELECT url_id, CASE length(host) % 4 WHEN 0 THEN NOT ((starts_with(path, '/en/') AND NOT starts_with(path, '/en/4')) OR path = '/fr/') WHEN 1 THEN NOT ends_with(path, '.html') WHEN 2 THEN path = '/robots.txt' ELSE true END AS allowed FROM r""")
def robots_verdicts(spark, sf_dir):
    """every page's address under its host's rules; hosts get one of three files, or none, by their length."""
    r = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    files = r.select("host", F.get(F.array(*map(F.lit, _BODIES)), F.length("host") % 4).alias("body")).where("body IS NOT NULL").distinct()
    return crawl.robots_verdicts(r, crawl.robots_rules(files), "Bot")


def answer_columns(rows):
    """rows (id, answer, facts, cited, expected): what of the facts and sources an answer covers, to three places."""
    c = F.col
    three = lambda x: F.round(x, 3).cast("string")
    return rows.select("id", three(answers.fact_coverage(c("answer"), c("facts"))).alias("facts"), three(answers.citation_precision(c("cited"), c("expected"))).alias("precision"), three(answers.citation_recall(c("cited"), c("expected"))).alias("recall"), three(answers.cited_source_coverage(c("cited"), c("expected"))).alias("sources"))


_HALVES = "CASE CAST(doc_id % 5 = doc_id % 3 AS INT) + CAST(doc_id % 4 = 1 AS INT) WHEN 2 THEN '1.0' WHEN 1 THEN '0.5' ELSE '0.0' END"


@query("answer_metrics", f"""WITH d AS (SELECT doc_id, trim(substr(text, 1, 20)) <> '' AND text IS NOT NULL AS has, contains(strip_accents(lower(coalesce(text, ''))), 'the') AS the FROM documents)
SELECT doc_id AS id, CASE WHEN has THEN CASE WHEN the THEN '0.667' ELSE '0.333' END WHEN the THEN '0.5' ELSE '0.0' END AS facts, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 THEN {_HALVES} END AS precision,
CASE WHEN doc_id % 11 > 0 THEN CASE WHEN doc_id % 7 > 0 THEN {_HALVES} ELSE '0.0' END END AS recall, CASE WHEN doc_id % 11 > 0 THEN CASE WHEN doc_id % 7 > 0 THEN {_HALVES} ELSE '0.0' END END AS sources FROM d""")
def answer_metrics(spark, sf_dir):
    """Every document as an answer that is to hold its own beginning, a common word and a fact it lacks."""
    cited = "CASE WHEN doc_id % 7 > 0 THEN array(concat('https://www.s', doc_id % 5, '.org/p/'), concat('http://c', doc_id % 4, '.net/1')) ELSE CAST(array() AS array<string>) END AS cited"
    wanted = "CASE WHEN doc_id % 11 > 0 THEN array(concat('http://s', doc_id % 3, '.org/q'), concat('https://C1.net/', doc_id % 2)) ELSE CAST(array() AS array<string>) END AS expected"
    d = table(spark, sf_dir, "documents")
    return answer_columns(d.selectExpr("doc_id AS id", "text AS answer", "array(coalesce(substr(text, 1, 20), ' '), 'THE ', concat('no such fact ', doc_id), ' ') AS facts", cited, wanted))


@query("passage_rerank")
def passage_rerank(spark, sf_dir):
    """The passages of the documents that cover half of a query's words."""
    from .texts import query_coverage

    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.offset_passages(F.col("text"))).alias("pos", "c")).select("doc_id", "pos", F.col("c.text").alias("text"), text.tokenize(F.col("c.text")).alias("tokens"))
    d = written(d.withColumn("n_tokens", F.size("tokens")), "passages")  # cut and read once, however many queries want them
    b = written(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), text.tokenize(F.col("text")).alias("asked")), "asked")
    wanted = written(query_coverage(spark, sf_dir).select("item_id", "doc_id"), "wanted")
    p = wanted.join(d, "doc_id").join(b, "item_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("source_id"), "query", "asked", "pos", "text", "tokens", "n_tokens")
    return rerank.reranked_passages(p, 5, 3).select("query_id", "source_id", "pos", "score", "rank")


@query("result_rerank")
def result_rerank(spark, sf_dir):
    """Hits with a document's source as title and its text as description."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("title"), F.col("text").alias("description"))
    b = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    h = hits(spark, sf_dir).groupBy("query_id", "key").agg(F.max("score").alias("engine_score")).join(d, "key").join(b, "query_id").withColumn("authority", F.lit(0.5))
    return rerank.reranked_results(h).select("query_id", "key", "reranked")


@query("evidence_gaps")
def evidence_gaps(spark, sf_dir):
    """O07."""
    b = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    e = hits(spark, sf_dir).join(table(spark, sf_dir, "documents").selectExpr("doc_id AS key", "text AS quote"), "key").selectExpr("query_id", "quote", "least(score / 100, 1.0) AS support")
    return answers.gaps(e, b)
