"""Research, discovery, extraction and places of names over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import authority, dates, payload, scores, text
from ..operators import gazetteer, local, research
from ..sources import extract
from .answers import _pick, _sql, _view
from .common import _LAT, _LON, HITS, NOW, hits, sql_haversine, table
from .understanding import _asked


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query")


@query("research_packs")
def research_packs(spark, sf_dir):
    """The loop with its stop rule over the benchmark's texts as questions."""
    return research.research(*_texts(spark, sf_dir), "normal")[1]


@query("planned_queries")
def planned_queries(spark, sf_dir):
    """O05, O06."""
    return research.planned_queries(_asked(spark, sf_dir).selectExpr("p_partkey AS query_id", "q AS query"), research.mode("quick")["num_queries"], 2024)


_HOSTS = ("vnexpress.net", "www.reddit.com", "d.com", "quan.vn", "github.com")
_LANES = f"{HITS}, l AS (SELECT query_id, provider, key, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, key) AS rank, concat('https://', {_pick(_HOSTS, 'key')}, '/', key, '/') AS url FROM hits)"


def _lanes(spark, sf_dir):
    from ..operators import retrieval

    h = retrieval.ranked(hits(spark, sf_dir), ["query_id", "provider"], F.desc("score"), F.col("key"))
    return h.withColumn("url", F.concat(F.lit("https://"), F.expr(_pick(_HOSTS, "key")), F.lit("/"), "key", F.lit("/"))).withColumn("title", F.concat(F.lit("T"), "key"))


_KINDS = {h.removeprefix("www."): authority.DOMAINS.get(h.removeprefix("www."), ("specialist_blog" if h.endswith(".vn") else "unknown_seo_site", 0.7 if h.endswith(".vn") else 0.3)) for h in _HOSTS}


@query("evidence_package", f"""WITH {_LANES}, f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf, string_agg(provider, ',' ORDER BY provider) AS providers, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT *, {_pick(tuple(h.removeprefix('www.') for h in _HOSTS), 'key')} AS domain, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, concat({_pick(tuple(h.removeprefix('www.') for h in _HOSTS), 'key')}, '/', key)) AS rank FROM f QUALIFY rank <= 10)
SELECT query_id, rank, concat('https://', {_pick(_HOSTS, 'key')}, '/', key, '/') AS url, domain, providers, CASE domain {' '.join(f"WHEN '{h}' THEN '{k}'" for h, (k, _) in _KINDS.items())} END AS type, CASE domain {' '.join(f"WHEN '{h}' THEN {s}" for h, (_, s) in _KINDS.items())} END::DOUBLE AS authority,
 CASE WHEN n >= 2 AND domain IN ('reddit.com', 'd.com') THEN 'medium' ELSE CASE domain {' '.join(f"WHEN '{h}' THEN '{authority.TRUST[k]}'" for h, (k, _) in _KINDS.items())} END END AS trust, round(rrf, 9) AS score FROM t""")
def evidence_package(spark, sf_dir):
    """A report of each query's ten best sources."""
    return research.package(_lanes(spark, sf_dir))[0].drop("title")


@query("package_stats", f"""WITH {_LANES}, f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf FROM l GROUP BY 1, 2), t AS (SELECT *, {_pick(tuple(h.removeprefix('www.') for h in _HOSTS), 'key')} AS domain, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, concat({_pick(tuple(h.removeprefix('www.') for h in _HOSTS), 'key')}, '/', key)) AS rank FROM f QUALIFY rank <= 10),
s AS (SELECT query_id, count(*) AS candidates, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers_used FROM l GROUP BY 1), g AS (SELECT query_id, count(*) AS n, count(DISTINCT domain) AS independent_sources, count(*) FILTER (WHERE domain = 'vnexpress.net') AS high FROM t GROUP BY 1)
SELECT s.query_id, candidates, providers_used, candidates - n AS deduplicated, independent_sources, high, round(least(1.0, n / 10), 3) AS coverage FROM s JOIN g ON s.query_id = g.query_id""")
def package_stats(spark, sf_dir):
    """O30, A15, A20."""
    return research.package(_lanes(spark, sf_dir))[1]


_EXTRA = "SELECT user_id AS query_id, event_id AS pos, concat('HTTP://U', event_id % 31) AS url FROM events WHERE event_type = 'click'"
_OWN = "SELECT user_id AS query_id, event_id AS pos, concat('http://u', event_id % 17) AS url FROM events WHERE event_type = 'view'"


@query("augmented_hits", f"WITH b AS ({_OWN}), e AS ({_EXTRA}), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(url) ORDER BY pos) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = e.query_id AND lower(b.url) = lower(e.url)) QUALIFY n = 1) SELECT query_id, pos, url FROM b UNION ALL SELECT query_id, pos, url FROM x")
def augmented_hits(spark, sf_dir):
    """O23."""
    _view(spark, sf_dir, "events")
    return research.augmented(_sql(spark, _OWN), _sql(spark, _EXTRA)).select("query_id", "pos", "url")


_IMAGES = "SELECT user_id AS query_id, event_id AS pos, CASE WHEN event_id % 4 > 0 THEN concat('i', event_id % 23) ELSE '' END AS src_url, CASE WHEN event_id % 6 > 0 THEN concat('p', event_id % 5) END AS page_url FROM events WHERE event_type = '{}'"


@query("image_results", f"WITH c AS (SELECT *, 0 AS lane FROM ({_IMAGES.format('view')}) UNION ALL SELECT *, 1 FROM ({_IMAGES.format('click')})), k AS (SELECT *, coalesce(nullif(src_url, ''), nullif(page_url, '')) AS key FROM c), f AS (SELECT * FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY lane, pos) = 1) SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY lane, pos) AS rank FROM f QUALIFY rank <= 8")
def image_results(spark, sf_dir):
    """The first eight images of each query."""
    _view(spark, sf_dir, "events")
    return research.images(_sql(spark, _IMAGES.format("view")), _sql(spark, _IMAGES.format("click")), 8).select("query_id", "key", "rank")


@query("news_results", f"WITH {HITS} SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM hits WHERE provider = 'view' QUALIFY rank <= 5")
def news_results(spark, sf_dir):
    """The first five of the news lane."""
    h = hits(spark, sf_dir).withColumn("category", F.when(F.col("provider") == "view", "news").otherwise("general"))
    return research.news(h, 5).select("query_id", "key", "score", "rank")


@query("cached_answers", "WITH q AS (SELECT vec_id AS query_id, label % 3 AS suffix, embedding AS e FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 40 > 0), i AS (SELECT vec_id AS pos, label % 3 AS suffix, embedding AS x FROM embeddings QUALIFY row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id DESC) <= 200) SELECT query_id, concat('k', min(pos)) AS key FROM q JOIN i ON q.suffix = i.suffix AND list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(x AS DOUBLE[])) >= 0.5 GROUP BY 1")
def cached_answers(spark, sf_dir):
    """The first of the last 200 cached answers of a suffix (the index's limit) whose question is near; questions about today never come from the cache."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "label % 3 AS suffix", "CASE WHEN vec_id % 40 > 0 THEN 'what is it' ELSE 'news today' END AS query", "embedding")
    i = e.selectExpr("vec_id AS pos", "label % 3 AS suffix", "concat('k', vec_id) AS key", "embedding")
    return research.cached_answers(q, i, 0.5, 200)


_CANDIDATES = f"SELECT CAST(floor(s_suppkey / 40) AS BIGINT) AS query_id, s_suppkey AS pos, concat(CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'Quán Phở ' END, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE CAST(s_suppkey % 12 AS string) END) AS name, {_pick(('restaurant', 'cafe', '', None, 'bank'), 's_suppkey')} AS category, CASE WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey % 12, ' Lê Lợi') END AS address, CASE WHEN s_suppkey % 3 = 0 THEN concat('0901', lpad(CAST(s_suppkey % 12 AS string), 6, '0')) END AS phone, CAST(NULL AS string) AS hours, CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS string) AS price_level, CASE WHEN s_suppkey % 5 = 0 THEN 'https://pho.vn' END AS website, CASE WHEN s_suppkey % 4 > 0 THEN CAST({_LAT.format(k='s_suppkey')} AS DOUBLE) END AS lat, CASE WHEN s_suppkey % 4 > 0 THEN CAST({_LON.format(k='s_suppkey')} AS DOUBLE) END AS lon, CAST(NULL AS string) AS description, concat('u', s_suppkey % 30) AS source_url, 'web' AS origin FROM supplier"
_duck = lambda s: s.replace("AS string)", "AS VARCHAR)")


@query("merged_candidates")
def merged_candidates(spark, sf_dir):
    """Each query's candidates merged in order."""
    _view(spark, sf_dir, "supplier")
    return local.merged(_sql(spark, _CANDIDATES)).select("query_id", "pos", "name", "phone", "website", "lat", "lon", "supporting")


@query("recall_gate", f"""WITH c AS ({_duck(_CANDIDATES)}), u AS (SELECT query_id, count(*) FILTER (WHERE trim(name) <> '' AND lat IS NOT NULL AND lon IS NOT NULL) AS useful FROM c GROUP BY 1) SELECT query_id, useful, useful >= 5 AS sufficient FROM u""")
def recall_gate(spark, sf_dir):
    """Every named place with coordinates is a phở shop here, so it is useful."""
    _view(spark, sf_dir, "supplier")
    c = _sql(spark, _CANDIDATES)
    return local.recall_gate(c, c.select("query_id").distinct().withColumn("query", F.lit("quán phở gần đây")), 20)


@query("discovery_rank", f"""WITH c AS ({_duck(_CANDIDATES)}), d AS (SELECT *, {sql_haversine('15.5', '105.5', 'lat', 'lon')} / 400000.0 AS d FROM c)
SELECT query_id, pos, round((CAST(contains(lower(name), 'quán') AS INT) + CAST(contains(lower(name), 'phở') AS INT) + CAST(contains(lower(name), 'ngon') AS INT)) / 3.0 * 0.25 + CASE WHEN coalesce(category, '') IN ('', 'restaurant', 'cafe') THEN 0.20 ELSE 0 END + CASE WHEN contains(lower(coalesce(name, '')), 'phở') THEN 0.30 ELSE 0 END
 + CASE WHEN lat IS NULL OR lon IS NULL THEN 0 WHEN d <= 1 THEN 0.15 * (1 - d) ELSE -0.20 END + (CAST(address IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) + CAST(website IS NOT NULL AS INT)) / 4.0 * 0.10, 6) AS score FROM d""")
def discovery_rank(spark, sf_dir):
    """T20, M20."""
    _view(spark, sf_dir, "supplier")
    r = local.ranked(_sql(spark, _CANDIDATES), "quán phở ngon", "restaurant", 15.5, 105.5, 400.0, "phở")
    return r.select("query_id", "pos", F.round("score", 6).alias("score"))


@query("lane_quality", f"""WITH c AS ({_duck(_CANDIDATES)}), f AS (SELECT *, coalesce(category, '') IN ('', 'restaurant', 'cafe') AS fits, coalesce({sql_haversine('15.5', '105.5', 'lat', 'lon')} <= 400000, false) AS near FROM c)
SELECT query_id, count(*) FILTER (WHERE fits AND near) AS useful, count(*) FILTER (WHERE fits) AS exact_category, count(*) FILTER (WHERE near) AS geo_relevant, count(*) FILTER (WHERE name <> '' AND address IS NOT NULL AND (phone IS NOT NULL OR lat IS NOT NULL)) AS complete, count(*) AS n, count(*) FILTER (WHERE fits AND near) >= 5 AND count(*) FILTER (WHERE near) >= 3 AS sufficient FROM f GROUP BY 1""")
def lane_quality(spark, sf_dir):
    """F24."""
    _view(spark, sf_dir, "supplier")
    return local.assessed(_sql(spark, _CANDIDATES), "restaurant", 15.5, 105.5, 400.0)


@query("page_documents", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(lower(regexp_extract(html, '(?i)<html[^>]*\slang\s*=\s*["'']?([A-Za-z]+)', 1)), '') AS language FROM pages""")
def page_documents(spark, sf_dir):
    """Pages as documents; the bodies are held to examples in the tests."""
    p = extract.extracted(table(spark, sf_dir, "pages").withColumn("mime", F.lit("text/html; charset=utf-8")), "html")
    return p.select("page_id", "doc.title", "doc.language")


_FETCHED = "SELECT page_id, url, {} AS code, page_id * 100000 AS length FROM pages".format(_pick((200, 304, 404, 403, 429, 301, 503, 200, 410, 418), "page_id").replace("'", ""))


@query("fetch_statuses", f"WITH f AS ({_FETCHED}) SELECT page_id, CASE WHEN code = 304 THEN 'not_modified' WHEN code = 200 AND length > 10485760 THEN 'too_large' WHEN code = 200 THEN 'ok' WHEN code IN (404, 410) THEN 'gone' WHEN code = 403 THEN 'blocked' WHEN code = 429 THEN 'rate_limited' WHEN code = 301 THEN 'redirect' WHEN code = 503 THEN 'server_error' ELSE 'failed' END AS status FROM f")
def fetch_statuses(spark, sf_dir):
    """S36, O19."""
    _view(spark, sf_dir, "pages")
    return _sql(spark, _FETCHED).select("page_id", extract.fetch_status(F.col("code"), F.col("length")).alias("status"))


@query("reading_tiers", "WITH d AS (SELECT doc_id, concat('u', doc_id) AS url, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS n FROM documents), t AS (SELECT url, CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END AS a, CASE WHEN doc_id % 2 = 0 THEN n ELSE 0 END AS b FROM d) SELECT url, CASE WHEN a >= 100 THEN 'cache' WHEN b >= 100 THEN 'http' WHEN a > 0 THEN 'cache' WHEN b > 0 THEN 'http' END AS tier, greatest(a, b) > 0 AND greatest(a, b) < 100 AS degraded FROM t")
def reading_tiers(spark, sf_dir):
    """S37, S38, S32."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), "text")
    return extract.tiered(d.select("url"), [("cache", d.where("doc_id % 3 = 0")), ("http", d.where("doc_id % 2 = 0"))], 100).select("url", "tier", "degraded")


@query("site_urls", r"""WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']+)', 1)) AS href FROM pages), b AS (SELECT url, regexp_replace(trim(href), '#.*$', '') AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM l),
f AS (SELECT *, origin || regexp_replace(regexp_replace(url, '^https?://[^/?#]+|[?#].*$', '', 'g'), '[^/]*$', '') AS folder FROM b), a AS (SELECT CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN regexp_matches(h, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(h, '/') THEN origin || h ELSE CASE WHEN folder = origin THEN origin || '/' ELSE folder END || h END AS url FROM f UNION ALL SELECT url FROM pages)
SELECT DISTINCT url FROM a WHERE regexp_matches(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', ''), '(^|\.)example\.com$')""")
def site_urls(spark, sf_dir):
    """Every address of one site among pages and their links."""
    return extract.site_urls(table(spark, sf_dir, "pages"), "example.com")


_META = """SELECT doc_id, concat('http://d/', doc_id) AS canonical_url, CASE WHEN doc_id % 3 = 0 THEN concat('T', doc_id) ELSE '' END AS title, concat('{"name": "', CASE WHEN doc_id % 4 = 0 THEN concat('N', doc_id) ELSE '' END, '"', CASE doc_id % 5 WHEN 0 THEN ', "telephone": "0901"' WHEN 1 THEN ', "address": {"streetAddress": "1 A", "addressRegion": "HN"}' WHEN 2 THEN ', "geo": {"latitude": 1.5, "longitude": "2.5"}' WHEN 3 THEN ', "address": "12 B"' ELSE '' END, ', "@type": "Cafe"}') AS metadata FROM documents"""


@query("place_candidates", "SELECT CAST(doc_id AS VARCHAR) AS external_id, CASE WHEN doc_id % 4 = 0 THEN concat('N', doc_id) ELSE concat('T', doc_id) END AS raw_name, CASE doc_id % 5 WHEN 1 THEN '1 A, HN' WHEN 3 THEN '12 B' END AS raw_address, CASE WHEN doc_id % 5 = 0 THEN '0901' END AS raw_phone, CASE WHEN doc_id % 5 = 2 THEN 1.5 END AS lat, CASE WHEN doc_id % 5 = 2 THEN 2.5 END AS lon, 'Cafe' AS raw_category FROM documents WHERE doc_id % 5 < 4 AND (doc_id % 4 = 0 OR doc_id % 3 = 0)")
def place_candidates(spark, sf_dir):
    """S15."""
    _view(spark, sf_dir, "documents")
    return extract.place_candidates(_sql(spark, _META)).select("external_id", "raw_name", "raw_address", "raw_phone", "lat", "lon", "raw_category")


@query("pois_around", f"WITH p AS (SELECT s_suppkey AS id, s_name AS name, CAST({_LAT.format(k='s_suppkey')} AS DOUBLE) AS lat, CAST({_LON.format(k='s_suppkey')} AS DOUBLE) AS lon FROM supplier) SELECT name, round({sql_haversine('15.5', '105.5', 'lat', 'lon')}, 3) AS distance_m FROM p WHERE {sql_haversine('15.5', '105.5', 'lat', 'lon')} <= 300000 ORDER BY 2, 1 LIMIT 50")
def pois_around(spark, sf_dir):
    """The nearest points with a tag."""
    p = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", f"CAST({_LAT.format(k='s_suppkey')} AS DOUBLE) AS lat", f"CAST({_LON.format(k='s_suppkey')} AS DOUBLE) AS lon", "map('amenity', CASE WHEN s_suppkey % 2 = 0 THEN 'cafe' ELSE 'bar' END) AS tags")
    return extract.pois_around(p, 15.5, 105.5, 300.0, "amenity").select("name", F.round("distance_m", 3).alias("distance_m"))


_DATED = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '2024-01-05T10:00:00Z' WHEN 1 THEN '2024-01-05 10:00:00' WHEN 2 THEN '2023-12-01' WHEN 3 THEN '5/1/2024' WHEN 4 THEN 'soon' WHEN 5 THEN '' WHEN 6 THEN '2024-01-05T10:00:00+07:00' END AS raw, concat('{"a": {"datePublished": "', CASE event_id % 4 WHEN 0 THEN '2024-01-30' WHEN 1 THEN '2023-06-01' WHEN 2 THEN 'x' ELSE '2020-01-01' END, '"}, "first_seen": "2024-01-20", "meta": [{"property": "og:updated_time", "content": "', CASE WHEN event_id % 3 = 0 THEN '2024-01-25T00:00:00Z' ELSE '' END, '"}], "content_hash": "h', event_id % 2, '", "previous_content_hash": "h1"}') AS metadata FROM events"""


@query("document_dates", f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN epoch(TIMESTAMP '2024-01-05 10:00:00') WHEN 1 THEN epoch(TIMESTAMP '2024-01-05 10:00:00') WHEN 2 THEN epoch(TIMESTAMP '2023-12-01 00:00:00') WHEN 3 THEN epoch(TIMESTAMP '2024-01-05 00:00:00') WHEN 6 THEN epoch(TIMESTAMP '2024-01-05 03:00:00') END::BIGINT AS seconds,
 round(CASE WHEN event_id % 4 = 0 THEN 0.95 WHEN event_id % 3 = 0 THEN 0.90 WHEN event_id % 4 = 1 THEN 0.40 WHEN event_id % 4 = 2 THEN 0.80 ELSE 0.10 END + CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS raw_score, least(1.0, round(CASE WHEN event_id % 4 = 0 THEN 0.95 WHEN event_id % 3 = 0 THEN 0.90 WHEN event_id % 4 = 1 THEN 0.40 WHEN event_id % 4 = 2 THEN 0.80 ELSE 0.10 END + CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE 0 END, 6))::DOUBLE AS freshness FROM events""")
def document_dates(spark, sf_dir):
    """D06, D13, X75."""
    _view(spark, sf_dir, "events")
    e = _sql(spark, _DATED)
    f = F.round(dates.document_freshness(F.col("metadata"), F.expr(NOW)), 6)
    base = F.expr("round(CASE WHEN event_id % 4 = 0 THEN 0.95D WHEN event_id % 3 = 0 THEN 0.90D WHEN event_id % 4 = 1 THEN 0.40D WHEN event_id % 4 = 2 THEN 0.80D ELSE 0.10D END + CASE WHEN event_id % 2 = 0 THEN 0.1D ELSE 0D END, 6)")
    return e.select("event_id", F.unix_seconds(dates.parsed(F.col("raw"))).alias("seconds"), base.alias("raw_score"), f.alias("freshness"))


@query("small_scores", """WITH g AS (SELECT user_id, list(CASE WHEN event_id % 3 > 0 THEN 'x' ELSE ' ' END) AS t, sum(CASE WHEN event_id % 4 = 0 THEN value ELSE 0.01 END) AS cost, max(value) AS top, max(event_id) AS last FROM events GROUP BY 1)
SELECT user_id, round(len(list_filter(t, lambda x: trim(x) <> '')) / len(t), 9) AS retrieved, round(cost, 6) AS cost, round(least(1.0, CASE WHEN last % 2 = 0 THEN last ELSE 5 END / 4000), 9) AS depth, round(top / 100 * 0.30 + CASE last % 3 WHEN 0 THEN 0.85 ELSE 0.12 END * 0.25 + 0.1 + (CASE last % 2 WHEN 0 THEN 1.0 ELSE 0.5 END * 0.7 + 0.5 * 0.3) * 0.15, 9) AS legacy FROM g""")
def small_scores(spark, sf_dir):
    """A22, A42, M13, M22."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("collect_list(CASE WHEN event_id % 3 > 0 THEN 'x' ELSE ' ' END)").alias("t"), scores.cost(F.expr("CASE WHEN event_id % 4 = 0 THEN value END"), 0.01).alias("cost"), F.max("value").alias("top"), F.max("event_id").alias("last"))
    legacy = scores.legacy_source(F.col("top") / 100, F.expr("CASE last % 3 WHEN 0 THEN 'https://www.github.com/x' ELSE 'https://a.b/' END"), F.lit("red ring"), F.expr("CASE last % 2 WHEN 0 THEN 'Ring red' ELSE 'Ring' END"), F.lit("a red one"))
    return g.select("user_id", F.round(dates.retrieved_share(F.col("t")), 9).alias("retrieved"), "cost", F.round(scores.content_depth(F.expr("CASE WHEN last % 2 = 0 THEN last ELSE 0 END"), F.lit("12345")), 9).alias("depth"), F.round(legacy, 9).alias("legacy"))


@query("conversation_states", "SELECT conv_id, CAST(least(count(*), 20) AS INT) AS turns, min(CASE WHEN turn = 0 THEN length(text) END) > 500 AS cut, CAST(0 AS INT) AS sources FROM conversations GROUP BY 1")
def conversation_states(spark, sf_dir):
    """Each conversation stored as JSON and decoded again with its bounds."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.min(F.when(F.col("turn") == 0, F.length("text"))).alias("first"))
    raw = F.to_json(F.struct(F.col("turns"), F.lit("junk").alias("recent_sources"), F.lit("q").alias("last_query")))
    s = c.withColumn("s", payload.conversation_state(raw)).withColumn("s2", payload.conversation_state(F.to_json(F.struct("turns"))))
    longest = F.array_max(F.transform("s2.turns", lambda t: F.length(t.text)))
    return s.select("conv_id", F.size("s2.turns").alias("turns"), (F.col("first") > 500).alias("cut"), (F.size("s.recent_sources") + F.when(longest > 500, 1).otherwise(0)).alias("sources"))


_PLACED = "SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN concat('Tỉnh ', n_name) WHEN 1 THEN concat('from ', lower(n_name), ' to r', n_regionkey) WHEN 2 THEN upper(n_name) WHEN 3 THEN 'nowhere at all' ELSE concat('x', n_name) END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("gazetteer_lookup", f"WITH p AS ({_PLACED}) SELECT query_id, CASE query_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE concat('n', c_nationkey) END AS key, CASE query_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'contained' WHEN 2 THEN 'exact' END AS found FROM p JOIN customer ON c_custkey = query_id")
def gazetteer_lookup(spark, sf_dir):
    """Places of names by equality on runs of words."""
    _view(spark, sf_dir, "customer", "nation")
    units = spark.sql("SELECT concat('n', n_nationkey) AS key, n_name AS name, CAST(array() AS array<string>) AS aliases, true AS is_current FROM tessera_nation")
    return gazetteer.lookup(_sql(spark, _PLACED), units)


@query("admin_resolutions", """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, r_name, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey + 1 ELSE n_nationkey END AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT k AS query_id, 'resolved' AS status, concat('n', k, ',r', r) AS matched, concat('n', s, ',r', r) AS current, CASE WHEN s <> k THEN 0.95 ELSE 1.0 END AS confidence FROM n UNION ALL SELECT 100 + k, 'resolved', concat('n', k), concat('n', s, ',r', r), CASE WHEN s <> k THEN 0.85 ELSE 0.9 END FROM n""")
def admin_resolutions(spark, sf_dir):
    """Nations as districts of their regions; a third of them merged into the next one."""
    _view(spark, sf_dir, "nation", "region", "customer")
    units = spark.sql("SELECT concat('n', n_nationkey) AS key, n_name AS name, lower(n_name) AS normalized_name, 2 AS admin_level, concat('r', n_regionkey) AS parent_key, CASE WHEN n_nationkey % 3 = 1 THEN 'merged' ELSE 'current' END AS status FROM tessera_nation UNION ALL SELECT concat('r', r_regionkey), r_name, lower(r_name), 1, NULL, 'current' FROM tessera_region")
    moves = spark.sql("SELECT concat('n', n_nationkey) AS from_key, concat('n', n_nationkey + 1) AS to_key, 'merged_into' AS relation_type FROM tessera_nation WHERE n_nationkey % 3 = 1")
    aliases = spark.sql("SELECT concat('n', n_nationkey) AS unit_key, concat('land ', n_nationkey) AS normalized_alias FROM tessera_nation")
    q = spark.sql("SELECT n_nationkey AS query_id, concat(n_name, ', ', r_name) AS text FROM tessera_nation JOIN tessera_region ON n_regionkey = r_regionkey UNION ALL SELECT 100 + n_nationkey, concat('land ', n_nationkey) FROM tessera_nation")
    out = gazetteer.resolve(q, units, aliases, moves)
    return out.select("query_id", "status", F.array_join("matched", ",").alias("matched"), F.array_join("current", ",").alias("current"), "confidence")


@query("word_vectors")
def word_vectors(spark, sf_dir):
    """Hashed vectors of the benchmark's texts, and their scores against themselves without a model."""
    b = table(spark, sf_dir, "benchmark")
    v = b.select("item_id", "text", extract.embedded(F.col("text"), extract.hashed_embedding()).alias("v"))
    return v.select("item_id", F.round(scores.cosine(F.col("v"), F.col("v")), 6).alias("self"), extract.pair_scores(F.col("text"), F.col("text"), lambda a, b: None).alias("score"))


@query("token_scores", "SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring', 'x'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'ring', 'x']))), 9) AS jaccard FROM part")
def token_scores(spark, sf_dir):
    """Intersection and union of tokens."""
    p = table(spark, sf_dir, "part")
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("x"))
    return p.select("p_partkey", F.round(text.jaccard(F.array_distinct(a), b), 9).alias("jaccard"))
