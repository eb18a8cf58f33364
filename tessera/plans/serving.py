"""The serving projection over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import projection
from ..sources import generations
from .answers import _sql, _view
from .common import NOW, PLACES, places

_CANON = "SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 10 END AS business_id, s_name AS canonical_name, lower(s_name) AS normalized_name, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('c', s_nationkey) END AS canonical_category, concat(s_suppkey, ' St') AS address, CASE WHEN s_suppkey % 2 = 0 THEN concat('+84', s_suppkey) END AS phone, CAST(NULL AS string) AS website, CAST(NULL AS string) AS website_domain, CASE s_suppkey % 3 WHEN 0 THEN '{\"mon\": [\"08:00\"]}' WHEN 1 THEN 'bad' END AS opening_hours, CAST(s_suppkey % 90 AS DOUBLE) AS lat, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey % 180 AS DOUBLE) END AS lon, s_nationkey AS admin_unit_id, CASE s_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'strange' WHEN 2 THEN NULL ELSE 'permanently_closed' END AS status, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS confidence, CAST(s_suppkey % 6 AS int) AS source_count, CASE WHEN s_suppkey % 7 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS last_seen, TIMESTAMP '2024-01-02 00:00:00' AS updated_at, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 50 AS DOUBLE) / 10 END AS rating, s_suppkey % 900 AS review_count, CAST(NULL AS string) AS price_level, CASE WHEN s_suppkey % 6 = 0 THEN '' END AS primary_image_url, CASE s_suppkey % 4 WHEN 0 THEN '[\"u1\", \"u2\"]' WHEN 1 THEN 'x' END AS images FROM supplier"
_RECORDS = "SELECT c_custkey AS record_id, c_mktsegment AS provider, concat('x', c_custkey) AS external_id, CASE c_custkey % 4 WHEN 0 THEN concat(' Shop ', c_nationkey) WHEN 1 THEN concat('SHOP ', c_nationkey) WHEN 2 THEN CONCAT('SUPPLIER#', lpad(CAST(c_custkey % 100 AS string), 9, '0')) END AS raw_name FROM customer"
_LINKS = "SELECT c_custkey % 100 AS place_id, c_custkey AS record_id FROM customer WHERE c_custkey % 9 > 0"
_duck = lambda s: s.replace("AS string)", "AS VARCHAR)").replace("CAST(NULL AS string)", "CAST(NULL AS VARCHAR)")


def _docs(spark, sf_dir):
    _view(spark, sf_dir, "supplier", "customer")
    names = projection.alias_rows(_sql(spark, _LINKS), _sql(spark, _RECORDS))
    return projection.project(_sql(spark, _CANON), names, F.expr(NOW))


_ALIASES = f"r AS ({_duck(_RECORDS)}), l AS ({_duck(_LINKS)}), n AS (SELECT place_id, trim(raw_name) AS name FROM l JOIN r USING (record_id) WHERE trim(coalesce(raw_name, '')) <> ''), e AS (SELECT place_id, lower(name) AS low, min(name) AS name FROM n GROUP BY 1, 2)"


@query("serving_rebuild", f"""WITH c AS ({_duck(_CANON)}), {_ALIASES}, a AS (SELECT c.place_id, string_agg(e.name, '|' ORDER BY e.name) AS aliases FROM c JOIN e ON c.place_id = e.place_id AND e.low <> lower(trim(canonical_name)) AND e.low <> lower(trim(normalized_name)) GROUP BY 1)
SELECT CAST(c.place_id AS VARCHAR) AS place_id, CAST(business_id AS VARCHAR) AS business_id, canonical_name AS name, coalesce(aliases, '') AS aliases, coalesce(canonical_category, '') AS category, CASE WHEN status IN ('open', 'permanently_closed') THEN status ELSE 'unknown' END AS status, confidence,
 round(coalesce(exp(-(epoch({NOW}) - epoch(last_seen)) / 86400.0 / 180), 0.5), 9) AS freshness_score, coalesce(phone, '') AS phone, CASE WHEN c.place_id % 4 = 0 THEN 'u1' END AS primary_image_url, CASE WHEN c.place_id % 3 = 0 THEN '08:00' END AS monday, lat IS NOT NULL AND lon IS NOT NULL AS located, rating, CAST(review_count AS INT) AS review_count FROM c LEFT JOIN a ON c.place_id = a.place_id""")
def serving_rebuild(spark, sf_dir):
    """Canonical places and the names of their sources as serving documents."""
    d = projection.with_location(_docs(spark, sf_dir))
    return d.select(
        "place_id", "business_id", "name", F.array_join("aliases", "|").alias("aliases"), F.coalesce(F.get("category_ids", F.lit(0)), F.lit("")).alias("category"), "status", "confidence", F.round("freshness_score", 9).alias("freshness_score"), F.coalesce(F.get("phone", F.lit(0)), F.lit("")).alias("phone"),
        "primary_image_url", F.get_json_object("opening_hours", "$.mon[0]").alias("monday"), F.col("location").isNotNull().alias("located"), "rating", "review_count",
    )


_PROVENANCE = "SELECT l_suppkey AS place_id, concat('f', l_linenumber % 3) AS field, l_returnflag AS provider, concat('v', l_partkey % 5) AS value, CAST(l_partkey % 97 AS DOUBLE) / 97 AS weight, l_linenumber = 1 AS chosen FROM lineitem WHERE l_orderkey % 50 = 0"


@query("place_details", f"""WITH c AS ({_duck(_CANON)}), r AS ({_duck(_RECORDS)}), l AS ({_duck(_LINKS)}), s AS (SELECT place_id, count(*) AS sources, min(record_id) AS first_record, count(DISTINCT provider) AS providers FROM l JOIN r USING (record_id) GROUP BY 1), p AS ({_PROVENANCE}), q AS (SELECT place_id, count(*) AS provenance, min(field) AS first_field FROM p GROUP BY 1)
SELECT CAST(c.place_id AS VARCHAR) AS place_id, coalesce(sources, 0) AS sources, first_record, coalesce(providers, 0) AS providers, coalesce(provenance, 0) AS provenance, first_field FROM c LEFT JOIN s ON c.place_id = s.place_id LEFT JOIN q ON c.place_id = q.place_id""")
def place_details(spark, sf_dir):
    """Documents with lineage and provenance."""
    _view(spark, sf_dir, "lineitem")
    docs = _docs(spark, sf_dir)
    sources = projection.sources_of(_sql(spark, _LINKS), _sql(spark, _RECORDS))
    d = projection.details(docs, sources, _sql(spark, _PROVENANCE))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("place_id", none("sources").alias("sources"), F.get("sources", F.lit(0)).record_id.alias("first_record"), none(F.array_distinct(F.transform("sources", lambda s: s.provider))).alias("providers"), none("provenance").alias("provenance"), F.get("provenance", F.lit(0)).field.alias("first_field"))


@query("place_cards", f"""WITH {PLACES} SELECT CAST(place_id AS VARCHAR) AS place_id, name, category AS canonical_category, CAST(lat AS DOUBLE) AS lat, concat('https://www.google.com/maps/search/?api=1&query=', round(lat, 3), ',', round(lon, 3)) AS map_url, status FROM places WHERE status <> 'permanently_closed' AND contains(lower(name), 'supp')""")
def place_cards(spark, sf_dir):
    """the legacy filter's matches as response rows."""
    p = projection.legacy_matches(places(spark, sf_dir), "Supp x")
    none = F.lit(None)
    rows = p.selectExpr("CAST(place_id AS string) AS place_id", "name", "array(category) AS category_ids", "lat", "lon", "status", "confidence", "source_count", "freshness AS freshness_score", "rating", "review_count").withColumns({"address": none.cast("string"), "phone": F.array().cast("array<string>"), "website": none.cast("string"), "distance_m": none.cast("double"), "open_now": none.cast("boolean")})
    out = projection.cards(rows)
    return out.join(projection.stable(out).select("place_id"), "place_id").select("place_id", "name", "canonical_category", "lat", "map_url", "status")


_VOTED = "SELECT s_suppkey AS place_id, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'location', concat(s_nationkey, '.5,', s_suppkey) FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 'images', concat('[\"a', s_suppkey, '\", \"b\"]') FROM supplier WHERE s_suppkey % 2 = 0"


@query("canonical_fields", "SELECT s_suppkey AS place_id, s_name AS canonical_name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey + 0.5 END AS lat, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS DOUBLE) END AS lon, CASE WHEN s_suppkey % 2 = 0 THEN concat('a', s_suppkey) END AS primary_image_url FROM supplier")
def canonical_fields(spark, sf_dir):
    """N11, K16."""
    _view(spark, sf_dir, "supplier")
    return projection.canonical_fields(_sql(spark, _VOTED)).select("place_id", "canonical_name", "lat", "lon", "primary_image_url")


_STAGED = "SELECT c_custkey AS record_id, c_mktsegment AS provider, concat('Công ty ', c_name) AS raw_name, CASE WHEN c_custkey % 2 = 0 THEN '1, Phố  Huế' END AS raw_address, CASE WHEN c_custkey % 3 = 0 THEN '0901234567' END AS raw_phone, CASE WHEN c_custkey % 4 = 0 THEN 'OPERATIONAL' END AS raw_status, 1D AS lat, 2D AS lon FROM customer"


@query("contributor_view", "SELECT c_custkey AS record_id, lower(regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g')) AS norm_name, CASE WHEN c_custkey % 2 = 0 THEN '1 pho hue' ELSE '' END AS norm_address, 2 + CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 4 = 0 AS INT) AS n_fields FROM customer")
def contributor_view(spark, sf_dir):
    """N03."""
    _view(spark, sf_dir, "customer")
    return projection.contributor_view(_sql(spark, _STAGED), F.lit("food")).select("record_id", "norm_name", "norm_address", F.size("fields").alias("n_fields"))


@query("payload_split", "SELECT doc_id, strlen(text) > 4000 AS moved, CASE WHEN strlen(text) > 4000 THEN concat('blob/', sha256(text)) END AS payload_key FROM documents")
def payload_split(spark, sf_dir):
    """Payloads over a bound as blobs by their digest, joined back to show that none is lost."""
    _view(spark, sf_dir, "documents")
    staged = generations.stage(spark.table("tessera_documents"), ["doc_id", "text", "nothing"])
    thin, blobs = generations.split_payloads(staged, "text", 4000)
    both = thin.join(blobs.select("payload_key", F.lit(True).alias("there")), "payload_key", "left")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("there") & F.col("text").isNull()).alias("__m"), "payload_key").select("doc_id", F.coalesce("__m", F.lit(False)).alias("moved"), "payload_key")


@query("sync_status", "SELECT coalesce(a.id, b.id) AS passage_id, CASE WHEN a.id IS NULL THEN 'vector_only' WHEN b.id IS NULL THEN 'lexical_only' ELSE 'both' END AS sync_status FROM (SELECT doc_id AS id FROM documents WHERE doc_id % 3 > 0) a FULL JOIN (SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0) b ON a.id = b.id")
def sync_status(spark, sf_dir):
    """K25, J12, S45, S46."""
    from .common import table

    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return generations.dual_status(d.where("doc_id % 3 > 0").selectExpr("doc_id AS passage_id"), e.where("vec_id % 2 = 0").selectExpr("vec_id AS passage_id"))
