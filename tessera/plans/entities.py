"""Entity resolution, administrative graph and place search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph, resolution, serving
from .common import _LAT, _LON, NOW, PLACES, places, sql_haversine, table

_SRC = f"SELECT c_custkey AS id, concat('supplier ', c_custkey % 150) AS name, CASE WHEN c_custkey % 4 = 0 THEN concat('+84', c_custkey % 60) END AS phone, CASE WHEN c_custkey % 5 = 0 THEN concat('d', c_custkey % 70, '.vn') END AS domain, concat('cat', c_nationkey % 5) AS category, c_nationkey AS admin, CAST({_LAT.format(k='(c_custkey % 300)')} + 0.001 AS double) AS lat, CAST({_LON.format(k='(c_custkey % 300)')} AS double) AS lon FROM customer"
_DST = f"SELECT s_suppkey AS id, concat('supplier ', s_suppkey % 150) AS name, CASE WHEN s_suppkey % 3 = 0 THEN concat('+84', s_suppkey % 60) END AS phone, CASE WHEN s_suppkey % 2 = 0 THEN concat('d', s_suppkey % 70, '.vn') END AS domain, concat('cat', s_nationkey % 5) AS category, s_nationkey AS admin, CAST({_LAT.format(k='s_suppkey')} AS double) AS lat, CAST({_LON.format(k='s_suppkey')} AS double) AS lon FROM supplier"
_TOKENS = "list_filter(string_split({x}, ' '), lambda t: length(t) >= 3)"
_DIST = sql_haversine("s.lat", "s.lon", "p.lat", "p.lon")
_BLOCKS = f"""src AS ({_SRC}), dst AS ({_DST}),
pairs AS (SELECT s.id AS s_id, p.id AS p_id, s.name AS sn, p.name AS pn, s.phone AS sp, p.phone AS pp, s.domain AS sd, p.domain AS pd, s.category AS sc, p.category AS pc, {_DIST} AS dist_m FROM src s, dst p
 WHERE s.phone = p.phone OR s.domain = p.domain OR (s.admin = p.admin AND list_has_any({_TOKENS.format(x='s.name')}, {_TOKENS.format(x='p.name')})) OR {_DIST} <= 500),
blocked AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY coalesce(sp = pp, false) DESC, coalesce(sd = pd, false) DESC, dist_m NULLS LAST, p_id) AS place_rank FROM pairs QUALIFY place_rank <= 50),
named AS (SELECT *, list_distinct(string_split(sn, ' ')) AS a, list_distinct(string_split(pn, ' ')) AS b FROM blocked),
scored AS (SELECT *, least(1.0, round(0.45 * CASE WHEN sn = pn THEN 1.0 ELSE greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 0.9 * len(list_intersect(a, b)) / least(len(a), len(b))) END
 + 0.25 * CASE WHEN dist_m <= 30 THEN 1.0 WHEN dist_m >= 200 THEN -1.0 ELSE 1 - (dist_m - 30) / 170 END + 0.15 * CASE WHEN sp IS NULL OR pp IS NULL THEN 0.3 WHEN sp = pp THEN 1.0 ELSE 0.0 END + 0.10 * CASE WHEN sd IS NULL OR pd IS NULL THEN 0.3 WHEN sd = pd THEN 1.0 ELSE 0.0 END + 0.05 * CASE WHEN sc = pc THEN 1.0 ELSE 0.1 END, 9)) AS pair_score,
 CASE WHEN sn = pn AND dist_m <= 80 THEN 'name_geo' WHEN sp = pp AND dist_m <= 200 THEN 'phone' END AS force FROM named)"""


def _sides(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("tessera_supplier")
    return spark.sql(_SRC.replace("FROM customer", "FROM tessera_customer")), spark.sql(_DST.replace("FROM supplier", "FROM tessera_supplier"))


@query("entity_blocking", f"WITH {_BLOCKS} SELECT s_id, p_id, place_rank FROM blocked")
def entity_blocking(spark, sf_dir):
    """Candidate pairs by four equality joins."""
    src, dst = _sides(spark, sf_dir)
    return resolution.by_class(src, lambda s: resolution.block_pairs(s, dst).select("s_id", "p_id", "place_rank"))


@query("pair_scores", f"WITH {_BLOCKS} SELECT s_id, p_id, round(pair_score, 6) AS pair_score, force FROM scored")
def pair_scores(spark, sf_dir):
    """J05, X15, X16, M03."""
    src, dst = _sides(spark, sf_dir)
    scored = lambda s: resolution.scored_pairs(resolution.block_pairs(s, dst)).select("s_id", "p_id", F.round("pair_score", 6).alias("pair_score"), "force")
    return resolution.by_class(src, scored)


@query("resolved_entities", f"WITH {_BLOCKS}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY force IS NOT NULL DESC, pair_score DESC, p_id) = 1) SELECT s_id, p_id, force FROM best WHERE pair_score >= 0.62 OR force IS NOT NULL")
def resolved_entities(spark, sf_dir):
    """Each record's place."""
    src, dst = _sides(spark, sf_dir)
    return resolution.by_class(src, lambda s: resolution.matched(resolution.scored_pairs(resolution.block_pairs(s, dst))).select("s_id", "p_id", "force"))


_BALLOTS = "SELECT l_suppkey AS place_id, CASE l_linenumber % 3 WHEN 0 THEN 'hours' WHEN 1 THEN 'phone' ELSE 'name' END AS field, l_orderkey * 10 + l_linenumber AS record_id, l_returnflag AS provider, concat('v', l_partkey % 5) AS value, concat('v', l_partkey % 5) AS signature, CASE l_returnflag WHEN 'A' THEN 0.9D WHEN 'N' THEN 0.6D ELSE 0.5D END AS authority, l_shipdate AS observed_at FROM lineitem"
_VOTES = f"""b AS ({_BALLOTS.replace('0.9D', '0.9').replace('0.6D', '0.6').replace('0.5D', '0.5')}),
w AS (SELECT *, count(*) OVER (PARTITION BY place_id, field, signature) / count(*) OVER (PARTITION BY place_id, field) AS corroboration FROM b),
v AS (SELECT *, round(0.6 * CAST(authority AS DOUBLE) + 0.3 * exp(-greatest(0.0, epoch({NOW} - observed_at) / 86400.0) / CASE field WHEN 'hours' THEN 45.0 WHEN 'phone' THEN 180.0 ELSE 730.0 END) + 0.1 * corroboration, 4) AS weight FROM w),
c AS (SELECT *, row_number() OVER (PARTITION BY place_id, field ORDER BY weight DESC, record_id) = 1 AS chosen FROM v)"""


def _votes(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tessera_lineitem")
    return resolution.field_votes(spark.sql(_BALLOTS.replace("FROM lineitem", "FROM tessera_lineitem")), F.expr(NOW))


@query("field_votes", f"WITH {_VOTES} SELECT place_id, field, value, weight FROM c WHERE chosen")
def field_votes(spark, sf_dir):
    """The winning value of each field."""
    return _votes(spark, sf_dir).where("chosen").select("place_id", "field", "value", "weight")


@query("place_confidence", f"WITH {_VOTES} SELECT place_id, round(avg(weight) FILTER (WHERE chosen), 4) AS confidence, count(DISTINCT provider) AS source_count FROM c GROUP BY 1")
def place_confidence(spark, sf_dir):
    """A06, A07."""
    return resolution.place_confidence(_votes(spark, sf_dir))


_LINKS = f"SELECT c_nationkey * 100 + c_custkey % 100 AS place_id, c_custkey AS record_id, CAST({_LAT.format(k='(c_custkey % 40)')} AS double) AS lat, CAST({_LON.format(k='(c_custkey % 40)')} AS double) AS lon, CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END AS matcher_version FROM customer"


@query("geo_span_audit", f"""WITH l AS ({_LINKS}), far AS (SELECT s.place_id, max({_DIST}) AS span_m FROM l s JOIN l p ON s.place_id = p.place_id AND p.record_id > s.record_id GROUP BY 1 HAVING max({_DIST}) > 200), many AS (SELECT place_id, count(*) AS records FROM l GROUP BY 1 HAVING count(*) > 2)
SELECT coalesce(far.place_id, many.place_id) AS place_id, round(span_m, 3) AS span_m, records, concat_ws(',', CASE WHEN span_m IS NOT NULL THEN 'geo_span' END, CASE WHEN records IS NOT NULL THEN 'source_count' END) AS reasons FROM far FULL JOIN many ON far.place_id = many.place_id""")
def geo_span_audit(spark, sf_dir):
    """J07, A44."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    return resolution.geo_span_audit(spark.sql(_LINKS.replace("FROM customer", "FROM tessera_customer")), 200.0, 2)


@query("stale_links", f"WITH l AS ({_LINKS}) SELECT place_id, record_id FROM l WHERE place_id NOT IN (SELECT place_id FROM l WHERE matcher_version IS DISTINCT FROM 'v2')")
def stale_links(spark, sf_dir):
    """J24, R08, R23."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    return resolution.stale_places(spark.sql(_LINKS.replace("FROM customer", "FROM tessera_customer")), "v2").select("place_id", "record_id")


@query("brand_match", f"WITH {PLACES}, s AS ({_SRC}) SELECT s.id FROM s WHERE EXISTS (SELECT 1 FROM places p WHERE p.category = s.category AND p.admin_unit_id = s.admin AND p.status = 'open')")
def brand_match(spark, sf_dir):
    """A semi-join."""
    src, _ = _sides(spark, sf_dir)
    p = places(spark, sf_dir).where("status = 'open'")
    return src.join(p, (src.category == p.category) & (src.admin == p.admin_unit_id), "left_semi").select("id")


_NEAR = sql_haversine("15.5", "105.5", "lat", "lon")


@query("place_search", f"""WITH {PLACES}, c AS (SELECT *, {_NEAR} AS distance_m FROM places WHERE status IN ('open', 'unknown', 'temporarily_closed')),
s AS (SELECT place_id, distance_m, round(0.30 * 0 + 0.20 * exp(-distance_m / 750) + 0.08 * 0.5 + 0.08 * confidence + 0.07 * freshness + 0.06 * least(1.0, source_count / 3) + 0.06 * CASE status WHEN 'open' THEN 1.0 ELSE 0.6 END
 + 0.06 * least(1.0, (coalesce(rating, 3.5) * review_count + 35.0) / (review_count + 10.0) / 5.0) + 0.04 * least(1.0, ln(1 + review_count) / ln(1001)) + 0.05 * 0.5, 9) AS score FROM c WHERE distance_m <= 50000)
SELECT place_id, round(distance_m, 3) AS distance_m, score FROM s ORDER BY score DESC, s.distance_m, place_id LIMIT 20""")
def place_search(spark, sf_dir):
    """A top-k report around a point."""
    out = serving.place_search(places(spark, sf_dir), serving.Spec(lat=15.5, lon=105.5, radius_m=50_000, limit=20))
    return out.select("place_id", F.round("distance_m", 3).alias("distance_m"), "score")


@query("nearby_places", f"WITH {PLACES}, s AS ({_SRC}) SELECT s.id, p.place_id, round({_DIST}, 3) AS distance_m FROM s, places p WHERE {_DIST} <= 20000")
def nearby_places(spark, sf_dir):
    """Every place within 20 km of every record, by grid cells."""
    src, _ = _sides(spark, sf_dir)
    p = places(spark, sf_dir).select("place_id", "lat", "lon")
    return serving.geo_join(src.select("id", "lat", "lon"), p, 20_000.0).select("id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query("autocomplete", f"WITH {PLACES} SELECT place_id, name, 1.0 AS score FROM places WHERE regexp_matches(lower(name), '(^|\\s)supp') ORDER BY place_id LIMIT 10")
def autocomplete(spark, sf_dir):
    """A top-k report."""
    return serving.autocomplete(places(spark, sf_dir), "supp", 10)


_UNITS = "SELECT concat('n', n_nationkey) AS key, concat('r', n_regionkey) AS parent_key, n_name AS name FROM nation UNION ALL SELECT concat('r', r_regionkey), 'world', r_name FROM region UNION ALL SELECT 'world', NULL, 'World'"


@query("admin_ancestors", f"WITH RECURSIVE u AS ({_UNITS}), a AS (SELECT key, parent_key AS ancestor, 1 AS distance FROM u WHERE parent_key IS NOT NULL UNION ALL SELECT a.key, u.parent_key, a.distance + 1 FROM a JOIN u ON a.ancestor = u.key WHERE u.parent_key IS NOT NULL) SELECT key, ancestor, distance FROM a")
def admin_ancestors(spark, sf_dir):
    """J23, S39, S50."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("tessera_nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("tessera_region")
    return graph.ancestors(spark.sql(_UNITS.replace("FROM nation", "FROM tessera_nation").replace("FROM region", "FROM tessera_region")))


@query("admin_successors", """WITH RECURSIVE u AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'current' ELSE 'merged' END AS status FROM nation), m AS (SELECT n_nationkey AS f, n_nationkey - 1 AS t FROM nation WHERE n_nationkey % 4 <> 0),
w AS (SELECT key, key AS at_ FROM u UNION SELECT w.key, m.t FROM w JOIN u ON u.key = w.at_ AND u.status <> 'current' JOIN m ON m.f = w.at_) SELECT w.key, w.at_ AS successor FROM w JOIN u ON u.key = w.at_ WHERE u.status = 'current'""")
def admin_successors(spark, sf_dir):
    """Walk along transitions to the current unit."""
    n = table(spark, sf_dir, "nation")
    u = n.selectExpr("n_nationkey AS key", "CASE WHEN n_nationkey % 4 = 0 THEN 'current' ELSE 'merged' END AS status")
    return graph.current_successors(u, n.where("n_nationkey % 4 <> 0").selectExpr("n_nationkey AS from_key", "n_nationkey - 1 AS to_key"))


@query("units_with_aliases", "SELECT r_regionkey AS key, r_name AS name, array_to_string(list_sort(list(n_name) FILTER (WHERE n_name IS NOT NULL)), ',') AS aliases FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def units_with_aliases(spark, sf_dir):
    """J13."""
    u = table(spark, sf_dir, "region").selectExpr("r_regionkey AS key", "r_name AS name")
    a = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS key", "n_name AS alias")
    return graph.with_aliases(u, a).select("key", "name", F.array_join("aliases", ",").alias("aliases"))


@query("points_in_polygons", f"WITH {PLACES} SELECT place_id, CASE WHEN lon >= 106.0 THEN 'east' ELSE 'west' END AS unit FROM places WHERE lon >= 102.5 AND lat >= 10.0 AND lon < 108.0 AND lat < 20.0")
def points_in_polygons(spark, sf_dir):
    """Points joined to polygons by grid cells, boxes and ray casting."""
    ring = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    shapes = spark.createDataFrame([("east", ring((106.0, 10.0), (108.0, 10.0), (108.0, 20.0), (106.0, 20.0))), ("west", ring((102.5, 10.0), (106.0, 10.0), (106.0, 20.0), (102.5, 20.0)))], "unit string, ring array<struct<x:double,y:double>>")
    return serving.in_polygons(places(spark, sf_dir), shapes).select("place_id", "unit")


@query("open_now", "SELECT place_id, CASE WHEN place_id % 5 = 0 THEN NULL WHEN place_id % 7 = 0 THEN false WHEN o < c THEN 630 >= o AND 630 < c ELSE 630 >= o OR 630 < c END AS open FROM (SELECT s_suppkey AS place_id, s_suppkey % 24 * 60 AS o, s_suppkey * 7 % 24 * 60 AS c FROM supplier)")
def open_now(spark, sf_dir):
    """Hours over midnight wrap, null is unknown, empty is closed."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS place_id", "CAST(s_suppkey % 24 AS string) || ':00' AS o", "CAST(s_suppkey * 7 % 24 AS string) || ':00' AS c")
    hours = F.when(F.col("place_id") % 5 == 0, F.lit(None)).when(F.col("place_id") % 7 == 0, F.array().cast("array<struct<opens:int,closes:int>>")).otherwise(F.array(F.struct(serving.minutes(F.col("o")).alias("opens"), serving.minutes(F.col("c")).alias("closes"))))
    return s.select("place_id", serving.open_at(hours, F.lit(630)).alias("open"))
