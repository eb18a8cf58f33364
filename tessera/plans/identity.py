"""Identities, keys, access and provider rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import identity
from ..operators import providers
from .common import table
from .understanding import _ASKED, _asked

_RECORDS = "SELECT c_custkey AS id, c_mktsegment AS provider, CASE WHEN c_custkey % 3 = 0 THEN concat('x', c_custkey) WHEN c_custkey % 7 = 0 THEN '' END AS external_id, concat(' ', c_name, ' \"Phở\" ') AS name, CASE WHEN c_custkey % 4 > 0 THEN concat(c_custkey % 90, ' Phố\\\\', c_nationkey) END AS address, CASE c_custkey % 5 WHEN 0 THEN '+84 901 234 567' WHEN 1 THEN '0084-28-3822' WHEN 2 THEN '84912345678' WHEN 3 THEN '8491234' END AS phone, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 1000 AS DOUBLE) / 8 END AS lat, CAST(c_custkey % 700 AS DOUBLE) / 16 + 100 AS lon, CASE WHEN c_custkey % 6 = 0 THEN '{\"mon\": \"8\"}' END AS hours FROM customer"
_J = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
_TRIM = lambda x, low=True: _J(f"lower(trim(coalesce({x}, '')))" if low else f"trim(coalesce({x}, ''))")
_NUM = lambda x: f"coalesce(CAST(round({x}, 6) AS VARCHAR), 'null')"


@query("record_identity", f"""WITH r AS ({_RECORDS.replace(chr(92) * 2, chr(92))}), d AS (SELECT *, regexp_replace(coalesce(phone, ''), '\\D+', '', 'g') AS digits, sha1(unhex('{identity.POINTS.hex}') || encode(concat('p_', id))) AS h FROM r)
SELECT id, sha256(CASE WHEN coalesce(external_id, '') <> '' THEN concat('{{"e": ', {_J('external_id')}, ', "p": ', {_J('provider')}, '}}') ELSE concat('{{"a": ', {_TRIM('address')}, ', "lat": ', {_NUM('lat')}, ', "lon": ', {_NUM('lon')}, ', "n": ', {_TRIM('name')}, ', "p": ', {_J('provider')}, '}}') END) AS identity_hash,
 sha256(concat('{{"a": ', {_TRIM('address')}, ', "c": ', {_TRIM('provider')}, ', "e": ', {_J('external_id')}, ', "h": ', coalesce(hours, 'null'), ', "lat": ', {_NUM('lat')}, ', "lon": ', {_NUM('lon')}, ', "n": ', {_TRIM('name')}, ', "p": ', {_J('provider')}, ', "ph": ', {_TRIM('phone', False)}, ', "s": ', {_J("''")}, ', "w": ', {_J("''")}, '}}')) AS observation_hash,
 concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', CAST(instr('0123456789abcdef', h[17:17]) - 1 AS INT) % 4 + 1, 1), h[18:20], '-', h[21:32]) AS point_id,
 CASE WHEN starts_with(digits, '0084') THEN '0' || digits[5:] WHEN starts_with(digits, '84') AND (starts_with(trim(coalesce(phone, '')), '+') OR length(digits) = 11) THEN '0' || digits[3:] ELSE digits END AS local_phone FROM d""")
def record_identity(spark, sf_dir):
    """X08, X63, X64, X66."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    r, c = spark.sql(_RECORDS.replace("FROM customer", "FROM tessera_customer")), F.col
    none = F.lit(None).cast("string")
    return r.select(
        "id", identity.identity_hash(c("provider"), c("external_id"), c("name"), c("address"), c("lat"), c("lon")).alias("identity_hash"),
        identity.observation_hash(c("provider"), c("external_id"), c("name"), c("address"), c("phone"), none, c("provider"), none, c("hours"), c("lat"), c("lon")).alias("observation_hash"),
        identity.point_id(F.concat(F.lit("p_"), "id")).alias("point_id"), identity.local_phone(c("phone")).alias("local_phone"),
    )


@query("query_keys", f"""WITH a AS ({_ASKED}), f AS (SELECT *, trim(regexp_replace(replace(strip_accents(lower(q)), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS flat FROM a)
SELECT p_partkey, sha256(concat_ws(':', array_to_string(list_filter(string_split_regex(trim(lower(q)), '\\s+'), lambda w: w <> ''), ' '), 'fast', 'vi', CAST(p_partkey % 3 AS VARCHAR))) AS key, array_to_string(list_filter(CASE WHEN contains(flat, ' ') THEN [flat, replace(flat, ' ', '-')] ELSE [flat] END, lambda x: x <> ''), '|') AS forms FROM f""")
def query_keys(spark, sf_dir):
    """X74, X83."""
    return _asked(spark, sf_dir).select("p_partkey", identity.cache_key(F.col("q"), F.lit("fast"), F.lit("vi"), F.expr("CAST(p_partkey % 3 AS string)")).alias("key"), F.array_join(identity.match_forms(F.col("q")), "|").alias("forms"))


_PATHS = "SELECT page_id, concat(url, CASE page_id % 6 WHEN 0 THEN '/%7euser/%2Ax*y' WHEN 1 THEN '/a b+c%zz' WHEN 2 THEN '?utm_source=1&b=2&a=1&ref=q&flag#sec-2' WHEN 3 THEN '/é%c3%a9/$' WHEN 4 THEN '//#a b' ELSE '' END) AS u, CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('P', page_id % 4) END AS publisher FROM pages"


@query("path_forms", rf"""WITH p AS ({_PATHS}), s AS (SELECT *, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS raw, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS net, regexp_extract(u, '#([a-zA-Z0-9_-]+)$', 1) AS anchor,
 list_sort(list_transform(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(lower(x), '=', 1) NOT IN ({', '.join(repr(t) for t in identity.PIPELINE_TRACKING)}) AND NOT starts_with(split_part(lower(x), '=', 1), 'utm_')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS params FROM p),
c AS (SELECT *, CASE WHEN raw IN ('', '/') THEN '/' ELSE regexp_replace(raw, '/+$', '') END AS path FROM s),
f AS (SELECT *, concat(scheme, '://', net, path, CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, CASE WHEN anchor <> '' THEN '#' || anchor ELSE '' END) AS canonical FROM c)
SELECT page_id, canonical, substr(sha256(canonical), 1, 16) AS content_hash, url_encode(url_decode(regexp_replace(raw, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '%25\1', 'g'))) AS octets, CASE WHEN publisher = 'P1' THEN 'Title' ELSE 'Title - P1' END AS title FROM f""")
def path_forms(spark, sf_dir):
    """X19, X87, X88."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    p = spark.sql(_PATHS.replace("FROM pages", "FROM tessera_pages")).withColumn("n", identity.pipeline_url(F.col("u")))
    return p.select("page_id", "n.canonical", "n.content_hash", identity.robots_octets(F.regexp_extract("u", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)).alias("octets"), identity.without_publisher(F.lit("Title - P1"), F.col("publisher")).alias("title"))


_CALLS = "SELECT event_id, concat('/v1/', CASE event_id % 9 WHEN 0 THEN 'search' WHEN 1 THEN 'places/42' WHEN 2 THEN 'places/search' WHEN 3 THEN 'health' WHEN 4 THEN 'nope' WHEN 5 THEN 'research/stream' WHEN 6 THEN 'models/' WHEN 7 THEN '' ELSE 'auth/check' END) AS path, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('key', event_id % 7) AS key FROM events"


@query("scoped_calls", f"""WITH c AS (SELECT *, trim(substr(path, 5), '/') AS rel FROM ({_CALLS})), k(key_hash, tenant, revoked) AS (SELECT sha256(concat('key', i)), concat('t', i), i % 3 = 0 FROM range(6) r(i))
SELECT event_id, CASE WHEN method = 'GET' THEN CASE WHEN rel = 'models' THEN 'chat:use' WHEN regexp_matches(rel, '^places/[^/]+$') THEN 'places:read' WHEN rel IN ('health', 'capabilities', 'auth/check', '') THEN NULL ELSE 'admin:debug' END
 ELSE coalesce(CASE rel {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in providers.SCOPES.items())} END, 'admin:debug') END AS scope, tenant FROM c LEFT JOIN k ON sha256(key) = key_hash AND NOT revoked""")
def scoped_calls(spark, sf_dir):
    """F27, F29."""
    table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    calls = spark.sql(_CALLS.replace("FROM events", "FROM tessera_events")).withColumn("scope", providers.required_scope(F.col("path"), F.col("method")))
    keys = spark.range(6).select(identity.sha(F.concat(F.lit("key"), "id")).alias("key_hash"), F.concat(F.lit("t"), "id").alias("tenant"), F.when(F.col("id") % 3 == 0, F.lit(1)).alias("revoked_at"))
    return providers.key_contexts(calls, keys).select("event_id", "scope", "tenant")


_ITEMS = """SELECT page_id, page_id AS rank, page_id % 20 AS query_id, concat('{"url": "', CASE WHEN page_id % 11 = 0 THEN '' ELSE url END, '", "title": "', CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('T', page_id) END, '"', CASE page_id % 4 WHEN 0 THEN ', "body": "b"' WHEN 1 THEN ', "description": "", "snippet": "s"' ELSE '' END, ', "score": ', page_id % 7, CASE WHEN page_id % 3 = 0 THEN concat(', "publisher_domain": "pub', page_id % 5, '.vn"') ELSE '' END, ', "repo": "r', page_id % 2, '"}') AS item FROM pages"""


@query("provider_rows", f"""WITH i AS ({_ITEMS}), j AS (SELECT page_id, query_id, coalesce(item->>'$.url', '') AS url, coalesce(item->>'$.title', '') AS title, coalesce(nullif(item->>'$.description', ''), nullif(item->>'$.body', ''), nullif(item->>'$.snippet', '')) AS snippet, CAST(item->>'$.score' AS DOUBLE) AS score, item->>'$.publisher_domain' AS pub, item->>'$.repo' AS repo FROM i)
SELECT page_id, url, title, snippet, score, repo, url <> '' AND (title <> '' OR snippet IS NOT NULL) AS usable, coalesce(pub, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')) AS domain FROM j""")
def provider_rows(spark, sf_dir):
    """Raw items of any shape on one schema."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    raw = spark.sql(_ITEMS.replace("FROM pages", "FROM tessera_pages"))
    rows = providers.provider_rows(raw, "code", lane={"lane": "code"})
    return rows.select(F.col("rank").alias("page_id"), "url", "title", "snippet", "score", F.col("metadata")["repo"].alias("repo"), "usable", "domain")


@query("ranked_lane", f"""WITH i AS ({_ITEMS}), r AS (SELECT page_id, query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place FROM i) SELECT page_id, query_id, place, round(greatest(0.4, 1 - place * 0.02), 3) AS score FROM r WHERE place < 10""")
def ranked_lane(spark, sf_dir):
    """A top-k report of each query's lane."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    return providers.ranked_lane(spark.sql(_ITEMS.replace("FROM pages", "FROM tessera_pages")), 10, 0.4, 0.02).select("page_id", "query_id", "place", "score")


@query("provider_plans")
def provider_plans(spark, sf_dir):
    """The provider runs of every question."""
    return providers.plans(_asked(spark, sf_dir).withColumnRenamed("p_partkey", "query_id"))
