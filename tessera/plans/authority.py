"""Domains: authority, type, trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import authority as auth
from .common import table

#: Domains that the pages stand for, by page_id.
_SITES = ("vnexpress.net", "www.Tuoitre.vn", "sub.vbpl.vn", "docs.python.org", "mof.gov.vn", "x.edu", "tophay247.com", "giatot24gio.com", "quan-nho.vn", "old.reddit.com", "example.com", "https://github.com:443/a", "a.gov.uk", "maps.google.com", "docs.seo24h.com", "cafef.vn", "blog.medium.com", "shopee.vn")
_LANES = ("news", "legal", "product", "forum", None)


def _lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _picked(names, by: str) -> str:
    return f"CASE {by} % {len(names)} " + " ".join(f"WHEN {i} THEN {_lit(n)}" for i, n in enumerate(names)) + " END"


_BASE = f"SELECT page_id, url, {_picked(_SITES, 'page_id')} AS site, {_picked(_LANES, 'page_id')} AS lane, CASE WHEN page_id % 2 = 0 THEN 'vi' ELSE 'en' END AS lang, page_id % 3 AS extra FROM pages"
_KNOWN = ", ".join(f"({i}, {_lit(k)}, {_lit(t)}, {s})" for i, (k, (t, s)) in enumerate(auth.DOMAINS.items()))
_VERTICAL = ", ".join(f"({_lit(k)}, {_lit(lane)}, {s})" for k, v in auth.VERTICALS.items() for lane, s in v.items())
_FAMOUS = ", ".join(f"({_lit(f)})" for f in auth.FAMOUS)
_TRUST = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in auth.TRUST.items())
_FARM = f"(h IN ({', '.join(map(_lit, auth.FARMS))}) OR regexp_matches(h, '{auth.FARM_PATTERN}'))"


@query("domain_trust", rf"""WITH b AS ({_BASE}), n AS (SELECT *, regexp_replace(split_part(regexp_replace(CASE WHEN contains(lower(site), '://') THEN regexp_extract(lower(site), '://([^/?#]*)', 1) ELSE trim(lower(site), '.') END, '^www\.', ''), ':', 1), '^$', '') AS h FROM b),
known(i, name, kind, score) AS (VALUES {_KNOWN}), lanes(name, lane, score) AS (VALUES {_VERTICAL}), famous(name) AS (VALUES {_FAMOUS}),
m AS (SELECT page_id, arg_min(kind, i) AS kind, arg_min(score, i) AS score FROM n JOIN known ON h = name OR ends_with(h, '.' || name) GROUP BY 1),
v AS (SELECT page_id, max(score) AS score FROM n JOIN lanes ON (h = name OR ends_with(h, '.' || name)) AND n.lane = lanes.lane GROUP BY 1),
f AS (SELECT DISTINCT page_id FROM n JOIN famous ON h = name OR ends_with(h, '.' || name)),
c AS (SELECT n.*, m.kind, m.score AS known_score, v.score AS lane_score, f.page_id IS NOT NULL AS famous, regexp_matches(h, '(^|\.)(gov|edu|mil)$|(^|\.)(gov|edu)\.[^.]*$') AS registry, starts_with(h, 'docs.') AND NOT {_FARM} AS docs, {_FARM} AS farm FROM n LEFT JOIN m USING (page_id) LEFT JOIN v USING (page_id) LEFT JOIN f USING (page_id)),
t AS (SELECT *, CASE WHEN registry THEN CASE WHEN regexp_matches(h, '(^|\.)gov(\.|$)') THEN 'government' ELSE 'research_paper' END WHEN docs THEN 'official' WHEN kind IS NOT NULL THEN kind WHEN farm THEN 'unknown_seo_site' WHEN ends_with(h, '.vn') THEN 'specialist_blog' ELSE 'unknown_seo_site' END AS type,
 CASE WHEN registry THEN 1.0 WHEN docs THEN 0.85 WHEN kind IS NOT NULL THEN known_score WHEN farm THEN 0.18 WHEN ends_with(h, '.vn') THEN 0.7 ELSE 0.3 END AS base, greatest(CASE WHEN ends_with(h, '.vn') THEN 1.5 ELSE 0 END, CASE WHEN famous THEN 1.0 ELSE 0 END) AS boost FROM c)
SELECT page_id, h AS host, type, round(CAST(coalesce(lane_score, base) + CASE WHEN lang = 'vi' THEN boost ELSE 0 END AS DOUBLE), 6) AS authority, CAST(boost AS DOUBLE) AS boost,
 CASE WHEN regexp_matches(lower(url), '{auth.LOW_VALUE}') THEN 'low' WHEN extra > 0 AND (CASE type {_TRUST} END) IN ('low', 'unverified') THEN 'medium' ELSE CASE type {_TRUST} END END AS trust, round(0.7 * base + 0.3 * (extra / 4.0), 6) AS effective FROM t""")
def domain_trust(spark, sf_dir):
    """Cascades over the labels of a host; map lookups of its suffixes, no join."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    p = spark.sql(_BASE.replace("FROM pages", "FROM tessera_pages"))
    s = F.col("site")
    providers = F.when(F.col("extra") > 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    return p.select(
        "page_id", auth.host_of(s).alias("host"), auth.source_type(s).alias("type"), F.round(auth.authority(s, F.col("lane"), F.col("lang")), 6).alias("authority"), auth.local_boost(s).alias("boost"),
        auth.trust(F.col("url"), auth.host_of(s), providers).trust.alias("trust"), F.round(auth.effective(auth.base_authority(s), F.col("extra") / 4), 6).alias("effective"),
    )
