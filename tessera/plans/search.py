"""Retrieval, fusion, reranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scores, text
from ..operators import evaluation, retrieval
from .common import HITS, NOW, SQL_WORDS, hits, table

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
KEYWORDS = "list_filter(" + SQL_WORDS + f", lambda t: length(t) > 1 AND t NOT IN ({STOP}))"

BM25 = f"""d AS (SELECT doc_id, {KEYWORDS.format(x='text')} AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
wanted AS (SELECT item_id AS query_id, unnest(list_distinct({KEYWORDS.format(x='text')})) AS term FROM benchmark),
tf AS (SELECT doc_id AS doc, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
lexical AS (SELECT query_id, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM wanted JOIN tf USING (term) JOIN df USING (term), stats GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM lexical QUALIFY rank <= 60)"""


def _lexical(spark, sf_dir):
    return retrieval.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query"))


def _dense(spark, sf_dir, k=20):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.knn_topk(e, e.where("vec_id % 20 = 0"), k)


KNN = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
dense AS (SELECT query_id, vec_id AS doc, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings ON query_id <> vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM dense QUALIFY rank <= 20)"""


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc, score, rank FROM bm25")
def bm25_topk(spark, sf_dir):
    """Lexical lane, each benchmark item as a query."""
    return _lexical(spark, sf_dir)


@query("knn_topk", f"WITH {KNN} SELECT query_id, doc, score, rank FROM knn")
def knn_topk(spark, sf_dir):
    """Exact cosine lane."""
    return _dense(spark, sf_dir)


@query(
    "hybrid_search",
    f"""WITH {BM25}, {KNN},
lanes AS (SELECT query_id, 'lexical' AS provider, doc AS key, rank FROM bm25 UNION ALL SELECT query_id, 'vector', doc, rank FROM knn),
fused AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf, list_sort(list(DISTINCT provider)) AS lanes FROM lanes GROUP BY 1, 2),
scaled AS (SELECT *, min(rrf) OVER w AS lo, max(rrf) OVER w AS hi FROM fused WINDOW w AS (PARTITION BY query_id)),
top AS (SELECT query_id, key, round(rrf, 9) AS rrf, round(CASE WHEN hi = lo THEN 1.0 ELSE (rrf - lo) / (hi - lo) END, 9) AS score, array_to_string(lanes, '+') AS lanes FROM scaled)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS rank FROM top QUALIFY rank <= 20""",
)
def hybrid_search(spark, sf_dir):
    """Lexical and vector lanes fused by reciprocal rank, the first 20 of each query."""
    lane = lambda rows: rows.select("query_id", F.col("doc").alias("key"), "rank")
    return retrieval.hybrid({"lexical": lane(_lexical(spark, sf_dir)), "vector": lane(_dense(spark, sf_dir))}, 20)


@query("sparse_topk", f"""WITH d AS (SELECT doc_id AS doc, term AS idx, count(*) AS weight FROM (SELECT doc_id, unnest({KEYWORDS.format(x='text')}) AS term FROM documents) GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, term AS idx, count(*) AS q FROM (SELECT item_id, unnest({KEYWORDS.format(x='text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc, CAST(sum(weight * q) AS DOUBLE) AS score FROM q JOIN d USING (idx) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def sparse_topk(spark, sf_dir):
    """Dot products of sparse term vectors."""
    d = retrieval.postings(table(spark, sf_dir, "documents")).selectExpr("doc", "term AS index", "tf AS weight")
    q = retrieval.postings(table(spark, sf_dir, "benchmark"), "item_id").selectExpr("doc AS query_id", "term AS index", "tf AS weight")
    return retrieval.sparse_topk(d, q, 10).withColumn("score", F.col("score").cast("double"))


@query("late_interaction", f"""WITH {KNN}, h AS (SELECT query_id % 100 AS query_id, doc, max(score) AS score FROM knn GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM h QUALIFY rank <= 10""")
def late_interaction(spark, sf_dir):
    """Several query vectors of one query, the best match of a document counts."""
    h = _dense(spark, sf_dir).selectExpr("query_id % 100 AS query_id", "query_id AS token", "doc", "score")
    return retrieval.late_interaction(h, 10)


@query("rrf_weighted", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, key) AS rank FROM hits),
f AS (SELECT query_id, key, sum(CASE provider WHEN 'click' THEN 1.2 WHEN 'view' THEN 0.8 ELSE 1.0 END / (60 + rank)) AS rrf, array_to_string(list_sort(list(DISTINCT provider)), '+') AS lanes FROM r GROUP BY 1, 2)
SELECT query_id, key, round(rrf, 9) AS rrf, lanes, round(CASE WHEN max(rrf) OVER w = min(rrf) OVER w THEN 1.0 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END, 6) AS score FROM f WINDOW w AS (PARTITION BY query_id)""")
def rrf_weighted(spark, sf_dir):
    """Provider lanes with weights."""
    r = retrieval.ranked(hits(spark, sf_dir), ["query_id", "provider"], F.desc("score"), F.col("key"))
    f = retrieval.rrf(r, 60, {"click": 1.2, "view": 0.8})
    return f.select("query_id", "key", F.round("rrf", 9).alias("rrf"), F.array_join("lanes", "+").alias("lanes"), F.round("score", 6).alias("score"))


@query("rrf_subqueries", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, key) AS rank FROM hits)
SELECT query_id, key, round(sum(1.0 / (60 + rank)), 9) AS rrf, len(list(DISTINCT provider)) AS query_hits, array_to_string(list_sort(list(DISTINCT provider)), ',') AS matched FROM r GROUP BY 1, 2""")
def rrf_subqueries(spark, sf_dir):
    """Lists of sub-queries fused without weights."""
    r = retrieval.ranked(hits(spark, sf_dir), ["query_id", "provider"], F.desc("score"), F.col("key"))
    return retrieval.rrf(r).select("query_id", "key", F.round("rrf", 9).alias("rrf"), F.size("lanes").cast("long").alias("query_hits"), F.array_join("lanes", ",").alias("matched"))


@query("score_normalisation", f"""WITH {HITS} SELECT query_id, provider, key,
round(CASE WHEN max(score) OVER w = min(score) OVER w THEN CAST(score > 0 AS INT) ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS minmax,
round(CASE WHEN stddev_pop(score) OVER w = 0 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS zscore FROM hits WINDOW w AS (PARTITION BY query_id, provider)""")
def score_normalisation(spark, sf_dir):
    """W06."""
    h = retrieval.normalized(hits(spark, sf_dir)).withColumnRenamed("normalized", "minmax")
    return retrieval.normalized(h, "zscore").select("query_id", "provider", "key", F.round("minmax", 6).alias("minmax"), F.round("normalized", 6).alias("zscore"))


@query("best_per_url", f"""WITH {HITS} SELECT query_id, key, provider, score, min(pos) OVER (PARTITION BY query_id, key) AS first_pos FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, pos) = 1""")
def best_per_url(spark, sf_dir):
    """Highest score of a key at its first position."""
    return retrieval.best_per_key(hits(spark, sf_dir), ["query_id", "key"]).select("query_id", "key", "provider", "score", "first_pos")


@query("first_per_url", f"""WITH {HITS} SELECT query_id, key, provider, pos FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY pos) = 1""")
def first_per_url(spark, sf_dir):
    """W08, W33, W14, U03, U07."""
    return retrieval.first_per_key(hits(spark, sf_dir), ["query_id", "key"]).select("query_id", "key", "provider", "pos")


@query("domain_cap", f"""WITH {HITS} SELECT query_id, domain, key, provider, score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, pos) <= 2""")
def domain_cap(spark, sf_dir):
    """W09, W12, W13."""
    return retrieval.capped(hits(spark, sf_dir), ["query_id", "domain"], 2, F.desc("score"), F.col("pos")).select("query_id", "domain", "key", "provider", "score")


@query("url_prerank", f"""WITH {HITS}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY pos) AS n FROM hits),
s AS (SELECT query_id, domain, key, pos, round(0.30 * ((key % 10) / 10.0) + 0.25 * ((pos % 8) / 8.0) + 0.15 * ((pos % 5) / 5.0) + 0.10 * (1 - least(0.2 * (n - 1), 1.0)) - 0.20 * CAST(key % 13 = 0 AS INT), 9) AS prerank FROM x),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, domain ORDER BY prerank DESC, pos) <= 2)
SELECT query_id, domain, key, prerank, row_number() OVER (PARTITION BY query_id ORDER BY prerank DESC, pos) AS rank FROM c QUALIFY rank <= 8""")
def url_prerank(spark, sf_dir):
    """W10."""
    h = hits(spark, sf_dir).selectExpr("query_id", "domain", "key", "pos", "(key % 10) / 10D AS entity", "(pos % 8) / 8D AS authority", "(pos % 5) / 5D AS fresh", "CAST(key % 13 = 0 AS int) AS spam")
    return retrieval.preranked(h, 8).select("query_id", "domain", "key", "prerank", "rank")


@query("diversity_penalties", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM hits),
c AS (SELECT *, count(*) FILTER (WHERE rank <= 10) OVER (PARTITION BY query_id, domain) AS top, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id, domain) AS same, row_number() OVER (PARTITION BY query_id, domain ORDER BY rank) AS nth FROM r)
SELECT query_id, key, provider, rank, CASE WHEN top > 0.2 * least(n, 10) AND nth > 1 THEN greatest(score - 0.15, 0.0) ELSE score END AS penalised, round(CASE WHEN n <= 1 THEN 0.0 ELSE least(same / n, 1.0) * 0.3 END, 9) AS penalty FROM c""")
def diversity_penalties(spark, sf_dir):
    """W11, W35, A16."""
    r = retrieval.ranked(hits(spark, sf_dir), ["query_id"], F.desc("score"), F.col("pos"))
    return retrieval.domain_share_penalty(retrieval.crowd_penalty(r, share=0.2)).select("query_id", "key", "provider", "rank", "penalised", F.round("penalty", 9).alias("penalty"))


_AGE = f"greatest(0.0, epoch({NOW} - o_orderdate) / 86400.0)"
_LANE = "CASE o_orderkey % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'document' WHEN 2 THEN 'medical' ELSE 'other' END"
_FRESH = f"greatest(0.0, least(1.0, 1 - {_AGE} / CASE {_LANE} WHEN 'legal' THEN 7300.0 WHEN 'document' THEN 3650.0 WHEN 'medical' THEN 1460.0 ELSE 1826.25 END))"


@query("quality_scores", f"""WITH x AS (SELECT o_orderkey, (o_custkey % 100) / 100.0 AS rel, (o_custkey % 10) / 10.0 AS auth, {_FRESH} AS fresh, (o_orderkey % 7) / 7.0 AS other FROM orders)
SELECT o_orderkey AS key, round(fresh, 9) AS fresh, round(greatest(0.0, least(1.0, 0.35 * rel + 0.25 * auth + 0.25 * fresh - 0.10 * other * 0.3 + 0.05 * other)), 9) AS v1,
round(greatest(0.0, least(1.0, 0.40 * rel + 0.20 * other + 0.15 * auth + 0.10 * fresh + 0.10 * other + 0.05 * rel)), 9) AS v2 FROM x""")
def quality_scores(spark, sf_dir):
    """Composite scores with freshness by lane."""
    o = table(spark, sf_dir, "orders")
    fresh = scores.freshness(F.col("o_orderdate"), F.expr(NOW), F.expr(_LANE))
    x = o.select(F.col("o_orderkey").alias("key"), F.expr("(o_custkey % 100) / 100D").alias("rel"), F.expr("(o_custkey % 10) / 10D").alias("auth"), fresh.alias("fresh"), F.expr("(o_orderkey % 7) / 7D").alias("other"))
    c = F.col
    return x.select("key", F.round("fresh", 9).alias("fresh"), F.round(scores.quality_v1(c("rel"), c("auth"), c("fresh"), c("other") * 0.3, c("other")), 9).alias("v1"), F.round(scores.quality_v2(c("rel"), c("other"), c("auth"), c("fresh"), c("other"), c("rel")), 9).alias("v2"))


@query("two_stage_rerank", f"""WITH {HITS}, k AS (SELECT query_id, key, max(score) / 100 AS quality, (key * 37 % 101) / 101.0 AS semantic FROM hits GROUP BY 1, 2),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, key) <= 10),
b AS (SELECT *, round(0.5 * semantic + 0.5 * quality, 9) AS blend FROM f)
SELECT query_id, key, blend, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, key) AS rank FROM b QUALIFY rank <= 5""")
def two_stage_rerank(spark, sf_dir):
    """T11, T14, T25."""
    k = hits(spark, sf_dir).groupBy("query_id", "key").agg((F.max("score") / 100).alias("quality")).withColumn("semantic", F.expr("(key * 37 % 101) / 101D"))
    return retrieval.blended(k, 5).select("query_id", "key", "blend", "rank")


@query("context_packing", f"""WITH {HITS}, k AS (SELECT query_id, key, max(score) AS score FROM hits GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM k),
t AS (SELECT r.*, d.text, sum(length(d.text) // 4) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r JOIN documents d ON d.doc_id = r.key),
b AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM t WHERE used <= 3000)
SELECT query_id, key, rank, used, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE n - rank / 2 + 1 END AS INT) AS place FROM b""")
def context_packing(spark, sf_dir):
    """A token budget, then the strongest rows at both ends."""
    k = hits(spark, sf_dir).groupBy("query_id", "key").agg(F.max("score").alias("score"))
    r = retrieval.ranked(k, ["query_id"], F.desc("score"), F.col("key"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return retrieval.lost_in_middle(retrieval.token_budget(r.join(d, "key"), 3000)).select("query_id", "key", "rank", "used", "place")


@query("ranking_metrics", f"""WITH {HITS}, k AS (SELECT query_id, key, max(score) AS score FROM hits GROUP BY 1, 2),
runs AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS pos FROM k QUALIFY pos <= 10),
want AS (SELECT DISTINCT query_id, key FROM k WHERE (query_id + key) % 5 = 0),
n AS (SELECT query_id, count(*) AS n_expected FROM want GROUP BY 1),
f AS (SELECT runs.*, want.key IS NOT NULL AS rel FROM runs LEFT JOIN want USING (query_id, key)),
g AS (SELECT query_id, sum(CASE WHEN rel THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg, min(pos) FILTER (WHERE rel) AS first, count(DISTINCT key) FILTER (WHERE rel) AS found, count(*) FILTER (WHERE rel) AS hits, count(*) AS got FROM f GROUP BY 1)
SELECT query_id, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_expected, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg, round(coalesce(1 / first, 0), 9) AS mrr, round(coalesce(found / n_expected, 0), 9) AS recall, round(coalesce(hits / 10, 0), 9) AS precision, round(coalesce(hits / got, 0), 9) AS precision_retrieved FROM n LEFT JOIN g USING (query_id)""")
def ranking_metrics(spark, sf_dir):
    """W20-W25, W29-W32, A45, O25."""
    k = hits(spark, sf_dir).groupBy("query_id", "key").agg(F.max("score").alias("score"))
    runs = retrieval.ranked(k, ["query_id"], F.desc("score"), F.col("key")).withColumnRenamed("rank", "pos")
    return evaluation.ranking_metrics(runs, k.where("(query_id + key) % 5 = 0"), 10)


@query("golden_report", f"""WITH {HITS}, k AS (SELECT query_id, key, max(score) AS score FROM hits GROUP BY 1, 2),
runs AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS pos FROM k QUALIFY pos <= 20),
f AS (SELECT query_id, min(pos) FILTER (WHERE (query_id + key) % 5 = 0) AS first, count(*) FILTER (WHERE (query_id + key) % 5 = 0) AS found FROM runs GROUP BY 1),
n AS (SELECT query_id, count(*) AS n FROM k WHERE (query_id + key) % 5 = 0 GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(found / n, 0)), 6) AS recall FROM n LEFT JOIN f USING (query_id)""")
def golden_report(spark, sf_dir):
    """Means over the evaluation set."""
    k = hits(spark, sf_dir).groupBy("query_id", "key").agg(F.max("score").alias("score"))
    runs = retrieval.ranked(k, ["query_id"], F.desc("score"), F.col("key")).withColumnRenamed("rank", "pos")
    m = evaluation.ranking_metrics(runs, k.where("(query_id + key) % 5 = 0"), 20)
    return evaluation.mean_report(m, ["mrr", "recall"])


@query("report_overlap", f"""WITH {HITS}, a AS (SELECT DISTINCT query_id, key FROM hits WHERE provider = 'click'), b AS (SELECT DISTINCT query_id, key FROM hits WHERE provider = 'view'),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.key) AS nl, count(b.key) AS nr, count(*) FILTER (WHERE a.key IS NOT NULL AND b.key IS NOT NULL) AS common, count(*) AS either FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key GROUP BY 1)
SELECT query_id, common, round(common / either, 9) AS jaccard, round(common / nl, 9) AS recall FROM j WHERE nl > 0 AND nr > 0""")
def report_overlap(spark, sf_dir):
    """Two lanes as two reports."""
    h = hits(spark, sf_dir)
    return evaluation.domain_jaccard(h.where("provider = 'click'"), h.where("provider = 'view'"), "query_id", "key")


@query("source_diversity", f"""WITH {HITS} SELECT query_id, round(count(DISTINCT domain) / count(*), 9) AS diversity FROM hits GROUP BY 1""")
def source_diversity(spark, sf_dir):
    """A20, A41, A21."""
    return evaluation.source_diversity(hits(spark, sf_dir), "query_id", "domain")


@query("report_diff", """WITH n AS (SELECT event_type AS metric, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT metric, n.v AS new, b.v AS base, CASE WHEN (CASE WHEN metric = 'error' THEN -1 ELSE 1 END) * (n.v - b.v) > 1e-12 THEN '+' WHEN (CASE WHEN metric = 'error' THEN -1 ELSE 1 END) * (n.v - b.v) < -1e-12 THEN '-' ELSE '=' END AS verdict FROM n JOIN b USING (metric)""")
def report_diff(spark, sf_dir):
    """Even against odd users."""
    e = table(spark, sf_dir, "events")
    mean = lambda r: e.where(f"user_id % 2 = {r}").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.report_diff(mean(0), mean(1), ["error"]).select("metric", "new", "base", "verdict")
