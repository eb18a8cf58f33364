"""Further queries: gates, citations, histories, signatures, crawl state, reports, lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import authority, understanding
from ..operators import crawl, evaluation, evidence, graph, ingest, providers, research, resolution, retrieval, serving
from ..sources import extract
from .answers import _pick, _sql, _view
from .common import HITS, NOW, hits, table
from .evidence import _CLAIMS_SQL, _claims
from .understanding import _ASKED, _asked

_ITEMS = "SELECT doc_id % 30 AS query_id, doc_id AS pos, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(substr(md5(CAST(doc_id % 4 AS string)), 1, 15), substr('0137', CAST(doc_id % 4 AS int) + 1, 1)) END AS simhash FROM documents"


@query("near_dup_gate", f"WITH i AS ({_ITEMS.replace('AS string)', 'AS VARCHAR)')}) SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, simhash <> '' AND row_number() OVER (PARTITION BY query_id, simhash ORDER BY pos) > 1 AS dropped FROM i")
def near_dup_gate(spark, sf_dir):
    """The four fingerprints lie far apart, so only equal ones drop."""
    _view(spark, sf_dir, "documents")
    return evidence.near_dup_gate(_sql(spark, _ITEMS))


@query("citations", f"""WITH {_CLAIMS_SQL}, c AS (SELECT claim_key, kw, hash FROM (SELECT *, length(claim) % 40 AS hash FROM claims)), s AS (SELECT doc_id, doc_id % 40 AS q, text FROM documents WHERE coalesce(text, '') <> ''),
h AS (SELECT claim_key, doc_id, row_number() OVER (PARTITION BY claim_key ORDER BY doc_id) AS rank FROM c JOIN s ON q = hash WHERE len(list_filter(kw, lambda k: length(k) >= 3 AND contains(lower(text), k))) > 0 QUALIFY rank <= 3) SELECT claim_key, doc_id AS source_id, rank FROM h""")
def citations(spark, sf_dir):
    """Claims without evidence of their own cite the first three documents of their query that hold a keyword."""
    c = _claims(spark, sf_dir).withColumn("query_id", F.length("claim") % 40).withColumn("evidence", F.array().cast("array<bigint>"))
    s = table(spark, sf_dir, "documents").selectExpr("doc_id % 40 AS query_id", "doc_id AS pos", "doc_id AS source_id", "source AS url", "text")
    return evidence.citations(c, s).select("claim_key", "source_id", "rank")


@query("merged_history", """WITH t AS (SELECT conv_id, turn AS pos, role, text, 0 AS part FROM conversations UNION ALL SELECT conv_id, turn, role, text, 1 FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, 100 + turn, 'user', 'new', 1 FROM conversations),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, role, text ORDER BY part, pos) = 1) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS place, role, text FROM f""")
def merged_history(spark, sf_dir):
    """Turns of a state and of a request, each once."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn AS pos", "role", "text")
    more = c.where("pos % 2 = 0").unionByName(c.selectExpr("conv_id", "100 + pos AS pos", "'user' AS role", "'new' AS text"))
    return evidence.merged_history(c, more)


_VALUES = "SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' WHEN 2 THEN 'website' WHEN 3 THEN 'category' WHEN 4 THEN 'status' WHEN 5 THEN 'location' WHEN 6 THEN 'price' ELSE 'address' END AS field, CASE s_suppkey % 8 WHEN 0 THEN concat('Công ty  A', s_suppkey) WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN ' ABC' ELSE '0901234567' END WHEN 2 THEN 'https://www.X.com/a?b' WHEN 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'Zzz' ELSE 'Nhà hàng' END WHEN 4 THEN 'OPERATIONAL' WHEN 5 THEN '10.12345,106.98765' WHEN 6 THEN CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '$$' END ELSE '1, Phố Huế' END AS value FROM supplier"


@query("field_signatures", "SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN concat('a', s_suppkey) WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'abc' ELSE '+84901234567' END WHEN 2 THEN 'x.com' WHEN 3 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'zzz' ELSE 'food' END WHEN 4 THEN 'open' WHEN 5 THEN '10.123,106.988' WHEN 6 THEN CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '$$' END ELSE '1 pho hue' END AS signature FROM supplier")
def field_signatures(spark, sf_dir):
    """N04."""
    _view(spark, sf_dir, "supplier")
    return _sql(spark, _VALUES).select("id", resolution.signature(F.col("field"), F.col("value")).alias("signature"))


_STORED = "SELECT l_suppkey AS place_id, concat('f', l_linenumber % 2) AS field, l_orderkey * 10 + l_linenumber AS record_id, l_returnflag AS provider, 'v' AS value, l_quantity AS weight, l_shipdate AS observed_at, l_linenumber % 3 = 0 AS chosen FROM lineitem WHERE l_orderkey % 40 = 0"


@query("provenance_upsert", f"WITH o AS ({_STORED}), v AS (SELECT place_id, field, record_id, weight + 1 AS weight, true AS chosen FROM o WHERE record_id % 5 = 0), k AS (SELECT o.place_id, o.field, o.record_id, o.weight, o.chosen AND o.place_id NOT IN (SELECT place_id FROM v) AS chosen FROM o WHERE record_id % 5 <> 0) SELECT * FROM k UNION ALL SELECT * FROM v")
def provenance_upsert(spark, sf_dir):
    """K18."""
    _view(spark, sf_dir, "lineitem")
    o = _sql(spark, _STORED)
    v = o.where("record_id % 5 = 0").withColumns({"weight": F.col("weight") + 1, "chosen": F.lit(True)})
    return resolution.provenance(o, v).select("place_id", "field", "record_id", "weight", "chosen")


_RECORDS = "SELECT c_custkey AS id, concat('b', c_custkey % 60) AS norm_name, concat('c', c_nationkey % 5) AS category, CASE WHEN c_custkey % 4 = 0 THEN concat('p', c_custkey % 50) END AS phone, CAST(NULL AS string) AS domain, c_nationkey AS admin FROM customer"
_BUSINESSES = "SELECT s_suppkey AS business_id, concat('b', s_suppkey % 60) AS norm_name FROM supplier"
_OWNED = "SELECT s_suppkey AS business_id, concat('c', s_nationkey % 5) AS category, CASE WHEN s_suppkey % 3 = 0 THEN concat('p', s_suppkey % 50) END AS phone, CAST(NULL AS string) AS domain, s_nationkey AS admin FROM supplier"
_duck = lambda s: s.replace("AS string)", "AS VARCHAR)")


@query("business_matches", f"WITH r AS ({_duck(_RECORDS)}), b AS ({_BUSINESSES}), p AS ({_duck(_OWNED)}) SELECT r.id, min(b.business_id) AS business_id FROM r JOIN b ON r.norm_name = b.norm_name JOIN p ON p.business_id = b.business_id AND (p.category = r.category OR p.phone = r.phone OR p.domain = r.domain OR p.admin = r.admin) GROUP BY 1")
def business_matches(spark, sf_dir):
    """J06."""
    _view(spark, sf_dir, "customer", "supplier")
    return resolution.brand_matches(_sql(spark, _RECORDS), _sql(spark, _BUSINESSES), _sql(spark, _OWNED))


@query("token_near_pairs", None)
def token_near_pairs(spark, sf_dir):
    """J04, held to block_pairs in the tests."""
    from .entities import _sides

    return resolution.token_near_pairs(*_sides(spark, sf_dir)).select("s_id", "p_id")


_HOURS = """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '{"Thứ Hai": ["08:00–22:00", "bad"], "x": ["1"]}' WHEN 1 THEN '{"monday": ["Đóng cửa"]}' WHEN 2 THEN '{"MONDAY": ["Mở cửa cả ngày"]}' WHEN 3 THEN '{"tuesday": ["08:00-09:00"]}' WHEN 4 THEN '{"Monday": ["7:30 - 11:00", "13:00-24:00"]}' END AS hours FROM supplier"""


@query("day_ranges", "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '480-1320' WHEN 1 THEN '' WHEN 2 THEN '0-1440' WHEN 4 THEN '450-660,780-1440' END AS ranges FROM supplier")
def day_ranges(spark, sf_dir):
    """N05, D09."""
    _view(spark, sf_dir, "supplier")
    r = serving.day_ranges(F.col("hours"), "Monday")
    return _sql(spark, _HOURS).select("id", F.when(r.isNotNull(), F.array_join(F.transform(r, lambda x: F.concat_ws("-", x.opens, x.closes)), ",")).alias("ranges"))


@query("keyset_page", "SELECT doc_id FROM documents WHERE doc_id > 17 ORDER BY doc_id LIMIT 25")
def keyset_page(spark, sf_dir):
    """A page is a limit by nature."""
    return ingest.page(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 17, 25)


@query("last_by_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_by_key(spark, sf_dir):
    """K19, K44."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ingest.last_by_key(o, ["o_custkey"], "o_orderkey")


@query("index_rows", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CAST(len(list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS INT) AS word_count, substr(sha256(coalesce(text, '')), 1, 16) AS simhash FROM documents")
def index_rows(spark, sf_dir):
    """K26, X44."""
    return ingest.index_rows(table(spark, sf_dir, "documents")).select("doc_id", "content_hash", "word_count", "simhash")


@query("new_places", "SELECT count(*) AS n, min(i) AS lowest, max(i) AS highest, count(DISTINCT i) AS ids FROM (SELECT 1000 + row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier)")
def new_places(spark, sf_dir):
    """Ids are gapless behind the highest."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "CAST(s_suppkey AS double) AS lat", "CAST(NULL AS double) AS lon")
    return ingest.new_places(s, 1000).agg(F.count("*").alias("n"), F.min("place_id").alias("lowest"), F.max("place_id").alias("highest"), F.countDistinct("place_id").alias("ids"))


_SITES = "SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www[.]', '') AS domain, page_id FROM pages"


@query("expanded_seeds", rf"""WITH d AS ({_SITES}), s AS (SELECT DISTINCT domain FROM d), m AS (SELECT domain, concat('https://', domain, '/m', page_id % 4) AS url, 0 AS how FROM d), f AS (SELECT domain, concat('https://feeds.', domain, '/f') AS url, 1 AS how FROM s UNION ALL SELECT domain, 'https://other.org/f', 1 FROM s), p AS (SELECT domain, concat('https://', domain, x) AS url, 2 AS how FROM s, (VALUES ('/sitemap.xml'), ('/feed'), ('/rss')) t(x)),
a AS (SELECT domain, url, min(how) AS how FROM (SELECT * FROM m UNION ALL SELECT * FROM f UNION ALL SELECT * FROM p) WHERE url NOT LIKE '%other.org%' GROUP BY 1, 2) SELECT domain, url, how FROM a QUALIFY row_number() OVER (PARTITION BY domain ORDER BY how, url) <= 5""")
def expanded_seeds(spark, sf_dir):
    """Five addresses a site, inside it alone; every page names a sitemap of its site."""
    _view(spark, sf_dir, "pages")
    d = _sql(spark, _SITES)
    s = d.select("domain").distinct()
    maps = d.selectExpr("domain", "concat('https://', domain, '/m', page_id % 4) AS url").distinct()
    feeds = s.selectExpr("domain", "concat('https://feeds.', domain, '/f') AS url").unionByName(s.selectExpr("domain", "'https://other.org/f' AS url"))
    return crawl.expanded_seeds(s, maps, feeds, cap=5)


_FRONT = f"SELECT p_partkey AS url, p_size AS priority, {NOW} AS next_crawl, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' ELSE 'done' END AS status, CASE WHEN p_partkey % 3 = 1 THEN 'old' END AS claim_token, CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END END AS lease_until FROM part"


@query("claimed_batch", f"""WITH f AS ({_FRONT}), m AS (SELECT url FROM f WHERE status = 'pending' OR (status = 'leased' AND lease_until < {NOW}) ORDER BY priority DESC, next_crawl, url LIMIT 40)
SELECT f.url, CASE WHEN m.url IS NOT NULL AND f.url % 2 = 0 THEN 'done' WHEN m.url IS NOT NULL THEN 'leased' ELSE status END AS status, CASE WHEN m.url IS NOT NULL AND f.url % 2 = 0 THEN NULL WHEN m.url IS NOT NULL THEN 'w1' ELSE claim_token END AS claim_token FROM f LEFT JOIN m ON f.url = m.url""")
def claimed_batch(spark, sf_dir):
    """A batch is claimed, and outcomes count only under the token that holds the row."""
    _view(spark, sf_dir, "part")
    f = crawl.claimed(_sql(spark, _FRONT), F.expr(NOW), 40, "w1")
    done = f.where("url % 2 = 0").select("url", F.lit("w1").alias("claim_token"), F.lit("done").alias("status"), "next_crawl")
    return crawl.completed(f, done).select("url", "status", "claim_token")


@query("crawl_outcomes", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'robots_denied' WHEN page_id % 5 = 0 THEN 'unchanged' WHEN page_id % 5 = 1 THEN 'gone' WHEN page_id % 3 = 0 THEN 'low_content' WHEN page_id % 2 = 0 THEN 'unchanged' ELSE 'indexed' END AS outcome FROM pages")
def crawl_outcomes(spark, sf_dir):
    """O19."""
    p = table(spark, sf_dir, "pages")
    e = F.expr
    return p.select("page_id", crawl.crawl_outcome(e("CASE page_id % 5 WHEN 0 THEN 'not_modified' WHEN 1 THEN 'gone' ELSE 'ok' END"), e("page_id % 7 <> 0"), e("CASE WHEN page_id % 3 = 0 THEN 'low_content' ELSE 'success' END"), e("page_id % 2 <> 0")).alias("outcome"))


@query("url_aliases", """WITH u AS (SELECT page_id AS pos, concat(CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END, '://', CASE WHEN page_id % 3 = 0 THEN 'www.' ELSE '' END, 'a', page_id % 9, '.com/x', CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END) AS url FROM pages), e AS (SELECT concat('a', pos % 9, '.com/x') AS identity, url, min(pos) AS pos FROM u GROUP BY 1, 2)
SELECT identity, arg_min(url, pos) AS first, string_agg(url, ' ' ORDER BY pos) AS aliases FROM e GROUP BY 1""")
def url_aliases(spark, sf_dir):
    """A08, X18."""
    p = table(spark, sf_dir, "pages").selectExpr("page_id AS pos", "concat(CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'https' END, '://', CASE WHEN page_id % 3 = 0 THEN 'www.' ELSE '' END, 'a', page_id % 9, '.com/x', CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END) AS url")
    return retrieval.url_aliases(p).select("identity", "first", F.array_join("aliases", " ").alias("aliases"))


@query("merged_passages", "SELECT user_id AS query_id, concat('u', event_id % 5) AS url, event_id % 4 AS chunk_index, max(value) AS score, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, concat('u', event_id % 5), event_id % 4) AS rank FROM events GROUP BY 1, 2, 3 QUALIFY rank <= 6")
def merged_passages(spark, sf_dir):
    """W14."""
    e = table(spark, sf_dir, "events").selectExpr("user_id AS query_id", "concat('u', event_id % 5) AS url", "event_id % 4 AS chunk_index", "value AS score")
    return retrieval.merged_passages(e, 3)


@query("multi_query", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, key) AS rank FROM hits), f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf, round(max((key * 31 % 97) / 97.0), 9) AS quality FROM r GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS fused_rank FROM f)
SELECT query_id, key, quality, fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank > 8, CASE WHEN fused_rank <= 8 THEN quality END DESC, fused_rank) AS rank FROM o QUALIFY rank <= 15""")
def multi_query(spark, sf_dir):
    """Fused lists, the first eight ordered anew by quality."""
    r = retrieval.ranked(hits(spark, sf_dir), ["query_id", "provider"], F.desc("score"), F.col("key"))
    return retrieval.multi_query(r, F.expr("(key * 31 % 97) / 97D"), 15, 8)


@query("authority_means", f"WITH {HITS}, d AS (SELECT DISTINCT query_id, {_pick(('vnexpress.net', 'reddit.com', 'x.vn'), 'key')} AS d FROM hits) SELECT query_id, round(avg(CASE d WHEN 'vnexpress.net' THEN 0.88 WHEN 'reddit.com' THEN 0.55 ELSE 0.7 END), 4) AS authority FROM d GROUP BY 1")
def authority_means(spark, sf_dir):
    """A21."""
    h = hits(spark, sf_dir).withColumn("site", F.concat(F.lit("www."), F.expr(_pick(("vnexpress.net", "reddit.com", "x.vn"), "key"))))
    return evaluation.authority_mean(h, "query_id", "site", authority.base_authority)


@query("shadow_summary", "SELECT count(*) AS runs, round(avg((event_id % 11) / 10.0), 6) AS mean_recall, round(avg((event_id % 5) / 4.0), 6) AS mean_overlap, round(avg(value), 6) AS mean_latency_ms FROM events")
def shadow_summary(spark, sf_dir):
    """A23."""
    return evaluation.shadow_summary(table(spark, sf_dir, "events").selectExpr("(event_id % 11) / 10D AS recall", "(event_id % 5) / 4D AS overlap", "value AS latency_ms"))


@query("run_counters", "SELECT event_type AS run, count(*) AS seen, count(*) FILTER (WHERE event_id % 6 = 0) AS new, count(*) FILTER (WHERE event_id % 6 = 1) AS changed, count(*) FILTER (WHERE event_id % 6 IN (2, 3)) AS unchanged, count(*) FILTER (WHERE event_id % 6 = 4) AS invalid, count(*) FILTER (WHERE event_id % 6 = 5) AS failed FROM events GROUP BY 1")
def run_counters(spark, sf_dir):
    """A33."""
    e = table(spark, sf_dir, "events").selectExpr("event_type AS run", f"{_pick(('new', 'changed', 'unchanged', 'unchanged', 'invalid', 'failed'), 'event_id')} AS change_type")
    return evaluation.run_counters(e, ["run"])


@query("answer_report", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.5 END AS fact_coverage, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 0.5 END AS citation_precision, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 1.0 END AS citation_recall, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 0.5 END AS source_coverage, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 0.5 END AS unsupported_rate, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 0.5 END AS quote_rate FROM customer")
def answer_report(spark, sf_dir):
    """A31, A35-A40, O38."""
    none = F.array().cast("array<string>")
    one = F.struct(F.array(F.struct(F.lit("q").alias("quote"))).alias("evidence"))
    empty = F.struct(F.array().cast("array<struct<quote:string>>").alias("evidence"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("Đà Nẵng is big").alias("answer"), F.when(F.col("c_custkey") % 3 == 0, none).otherwise(F.array(F.lit("da nang"), F.lit("small"))).alias("facts"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("https://a.com/1"), F.lit("https://z.com/1"))).alias("cited"), F.array(F.lit("http://a.com/1")).alias("expected"),
        F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<struct<evidence:array<struct<quote:string>>>>")).otherwise(F.array(one, empty)).alias("citations"), F.array(F.lit("https://a.com/2"), F.lit("https://b.com/")).alias("sources"),
    )
    return evaluation.answer_report(c)


_M = lambda s: f"regexp_matches(low, '{understanding.word_pattern([providers.SIGNALS[s][0]])}" + (f"|(?:{providers.SIGNALS[s][1]})" if providers.SIGNALS[s][1] else "") + "')"


@query("lane_weights", f"""WITH a AS ({_ASKED}), l AS (SELECT *, lower(q) AS low FROM a), f AS (SELECT *, {_M('news')} OR regexp_matches(trim(low), '{understanding.FRESH}') AS news, {_M('legal')} AS legal, {_M('product')} AS product, {_M('market')} AS market, {_M('ecommerce')} AS shop, {_M('places')} AS places, {_M('code')} AS code, {_M('opinion')} AS opinion, {_M('forum')} AS forum, {_M('finance')} AS finance, {_M('company')} AS company, regexp_matches(trim(low), '{understanding.COMPARISON}') AS vs FROM l)
SELECT p_partkey, CAST(CASE WHEN news THEN 1.0 WHEN legal OR market OR company OR finance THEN 0.5 ELSE 0 END AS DOUBLE) AS news, CAST(CASE WHEN legal THEN 1.0 ELSE 0 END AS DOUBLE) AS legal, CAST(CASE WHEN market THEN 1.0 WHEN finance THEN 0.5 ELSE 0 END AS DOUBLE) AS market, CAST(CASE WHEN product THEN 1.0 WHEN shop AND NOT market THEN 0.5 ELSE 0 END AS DOUBLE) AS product,
 CAST(greatest(CASE WHEN product AND NOT market THEN 1.0 ELSE 0 END, CASE WHEN shop AND NOT product AND NOT market THEN 0.8 ELSE 0 END, CASE WHEN opinion OR vs THEN 0.5 ELSE 0 END, CASE WHEN places THEN 0.25 ELSE 0 END) AS DOUBLE) AS ecommerce, CAST(CASE WHEN code THEN 0.8 ELSE 0 END AS DOUBLE) AS code, CAST(0.8 AS DOUBLE) AS web FROM f""")
def lane_weights(spark, sf_dir):
    """X71."""
    w = _asked(spark, sf_dir).withColumn("w", providers.lane_weights(F.col("q")))
    return w.select("p_partkey", *[F.col("w")[lane].cast("double").alias(lane) for lane in ("news", "legal", "market", "product", "ecommerce", "code")], F.col("w")["general_web"].cast("double").alias("web"))


@query("evidence_batch")
def evidence_batch(spark, sf_dir):
    """Sources read in a batch: what failed, with why; the passages are held to examples in the tests."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id % 10 AS query_id", "doc_id AS pos", "CASE WHEN doc_id % 9 = 0 THEN 'http://10.0.0.1/x' ELSE concat('http://d', doc_id, '.com/') END AS url", "text", "doc_id")
    bodies = d.where("doc_id % 9 <> 0").select("url", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 8 == 0, "timeout").alias("error"))
    return research.evidence_batch(d.select("query_id", "pos", "url", F.lit("the and of").alias("query")), bodies)[1]


@query("pushed_records", "WITH c AS (SELECT c_custkey % 10 = 0 AS bad, c_custkey % 7 AS d FROM customer) SELECT count(*) AS seen, count(*) FILTER (WHERE NOT bad AND d = 1) AS new, count(*) FILTER (WHERE NOT bad AND d = 2) AS changed, count(*) FILTER (WHERE NOT bad AND d NOT IN (1, 2)) AS unchanged, count(*) FILTER (WHERE bad) AS invalid, 0 AS failed FROM c")
def pushed_records(spark, sf_dir):
    """Records through the ingest steps, as counters."""
    _view(spark, sf_dir, "customer")
    r = spark.sql(f"SELECT concat('x', c_custkey) AS external_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS raw_name, {NOW} AS observed_at, 10D AS lat, 106D AS lon, '' AS raw_phone, '' AS raw_website, false AS parse_error, md5(CAST(c_custkey % 7 AS string)) AS digest FROM tessera_customer")
    known = r.where("digest <> md5('1')").selectExpr("external_id", "CASE WHEN digest = md5('2') THEN 'other' ELSE digest END AS digest")
    return research.ingested(r, known, ["external_id"])[2]


@query("admin_graph", "SELECT concat('r', r_regionkey) AS key, CAST(count(n_nationkey) AS INT) AS children, CAST(0 AS INT) AS moves FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT concat('n', n_nationkey), 0, CAST(n_nationkey % 4 <> 0 AS INT) FROM nation")
def admin_graph(spark, sf_dir):
    """S50."""
    _view(spark, sf_dir, "nation", "region")
    units = spark.sql("SELECT concat('n', n_nationkey) AS key, n_name AS name, concat('r', n_regionkey) AS parent_key FROM tessera_nation UNION ALL SELECT concat('r', r_regionkey), r_name, NULL FROM tessera_region")
    moves = spark.sql("SELECT concat('n', n_nationkey) AS from_key, concat('n', n_nationkey - 1) AS to_key, 'merged_into' AS relation_type FROM tessera_nation WHERE n_nationkey % 4 <> 0")
    g = graph.admin_graph(units, units.where("false").select("key", F.col("name").alias("alias")), moves)
    return g.select("key", F.size("children").alias("children"), F.coalesce(F.size("moves"), F.lit(0)).alias("moves"))


@query("answers")
def answers(spark, sf_dir):
    """Answers from the cache, which has every seventh text, else from the research loop, for every benchmark text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark")
    vec = extract.embedded(F.col("text"), extract.hashed_embedding())
    q = b.select(F.col("item_id").alias("query_id"), F.lit("s").alias("suffix"), F.col("text").alias("query"), vec.alias("embedding"))
    cache = q.where("query_id % 7 = 0").select(F.col("query_id").alias("pos"), "suffix", F.concat(F.lit("cached "), "query_id").alias("key"), "embedding")
    out = research.answered(q, cache, docs)
    return out.select("query_id", "cached", F.length("answer").alias("n"))
