"""What queries ask: profiles, rewrites, parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import understanding as u
from .common import table

#: Questions about a part; {n} is its name ("new", a word of time, as "fresh") and {b} its brand.
_TEMPLATES = (
    "what is {n}", "so sánh {n} và {b}", "cách dùng {n} là gì", "latest news about {b}", "please compare {n} vs {b}", "giá vàng hôm nay", "python api error in {n}", "{b} price today", "how to install {n} with docker", "quán cà phê gần {b}", "nha thuoc gan day",
    "best {n} to buy", "review {b} and price", "rate limit of {n}", "kết quả bóng đá hôm qua", "deep dive analysis of {n}", "{n} design và giá", "cho tôi hỏi luật {b}", "docs.{b}.io guide", "thời tiết {n}", "{b} video tutorial", "open now {n} near me", "", "can you explain c++x {n}?", "machine learning {n} 2026", "khách sạn {b}",
)


def _asked_sql(cast: str) -> str:
    def built(t: str) -> str:
        t = "'" + t.replace("'", "''") + "'"
        return "concat(" + t.replace("{n}", "', replace(p_name, 'new', 'fresh'), '").replace("{b}", "', p_brand, '") + ")"

    return f"SELECT p_partkey, CASE p_partkey % {len(_TEMPLATES)} " + " ".join(f"WHEN {i} THEN {built(t)}" for i, t in enumerate(_TEMPLATES)) + " END AS q FROM part"


_ASKED = _asked_sql("")


def _asked(spark, sf_dir):
    # a row is small and what is asked of it is not: one file of parts would be one task
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    part.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").createOrReplaceTempView("tessera_part")
    return spark.sql(_ASKED.replace("FROM part", "FROM tessera_part"))


_m = lambda p, x="low": f"regexp_matches({x}, '{p}')"
_FOLDED = "trim(regexp_replace(replace(strip_accents(lower(q)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_SUFFIX_CASE = " ".join(f"WHEN kind = '{k}' AND lang = '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for k, langs in u.SUFFIXES.items() for lang, words in langs.items())
_TAXONOMY = "CASE " + " ".join(f"WHEN contains(low || ' ', '{m}') THEN '{c}'" for m, c in u.TAXONOMY.items()) + " " + " ".join(f"WHEN contains(plain, '{m}') THEN '{c}'" for m, c in u.FOLDED_TAXONOMY) + " ELSE '' END"


@query("query_profile", f"""WITH a AS ({_ASKED}), l AS (SELECT *, lower(q) AS low, trim(lower(q)) AS tlow, {_FOLDED} AS folded, trim(replace(strip_accents(lower(q)), 'đ', 'd')) || ' ' AS plain FROM a),
s AS (SELECT *, {_m(u.LIVE, 'tlow')} AS live, {_m(u.EVENT, 'tlow')} AS event, {_m(u.NUMERIC, 'tlow')} OR ({_m(u.RATES, 'tlow')} AND NOT contains(tlow, 'rate limit')) AS numeric, CASE WHEN {_m(u.TONES, 'tlow')} OR {_m(u.TONELESS, 'tlow')} THEN 'vi' ELSE 'en' END AS lang, {_TAXONOMY} AS category FROM l),
k AS (SELECT *, CASE WHEN live THEN 'live' WHEN event THEN 'event' WHEN numeric THEN 'numeric' END AS kind FROM s), w AS (SELECT *, list_filter(CASE {_SUFFIX_CASE} END, lambda x: NOT contains(lower(trim(q)), x))[1] AS suffix FROM k)
SELECT p_partkey, trim(regexp_replace(q, '{u.NOISE}', '')) AS stripped, CASE WHEN {_m(u.CODE_TYPE)} THEN 'code' WHEN {_m(u.RESEARCH_TYPE)} THEN 'research' ELSE 'web' END AS type,
 CASE WHEN {_m(u.CODE_FAMILY)} THEN 'code' WHEN {_m(u.RESEARCH_FAMILY)} THEN 'research' WHEN {_m(u.NEWS_FAMILY)} THEN 'news' ELSE 'web' END AS family,
 CASE WHEN {_m(u.QUICK)} THEN 'quick' WHEN {_m(u.DEEP)} THEN 'deep' ELSE 'normal' END AS depth, CASE WHEN {_m(u.NEWS)} THEN 'day' WHEN {_m(u.SHOPPING)} THEN 'week' WHEN {_m(u.TECH)} THEN 'month' ELSE 'any' END AS freshness, {_m(u.OFFICIAL)} AS official_first,
 concat_ws(',', 'general', {', '.join(f"CASE WHEN {_m(p)} THEN '{c}' END" for c, p in u.CATEGORIES.items())}) AS categories,
 CASE WHEN {_m(u.COMPARISON, 'tlow')} THEN 'comparison' WHEN {_m(u.FRESH, 'tlow')} THEN 'current_fact' WHEN {_m(u.DEFINITION, 'tlow')} THEN 'definition' WHEN {_m(u.HOWTO, 'tlow')} THEN 'howto' WHEN {_m(u.OPINION, 'tlow')} THEN 'opinion' ELSE 'current_fact' END AS intent,
 CASE WHEN {_m(u.TONES, 'tlow')} THEN 'vi' ELSE 'en' END AS language, {_m(u.FRESH, 'tlow')} AS freshness_required,
 array_to_string(list_filter(regexp_extract_all(tlow, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(x) for x in u.PROFILE_STOPWORDS)})), ' ') AS entities,
 CASE WHEN {_m(u.LOCAL_NOW, 'folded')} THEN 'hours' WHEN {_m(u.CURRENT, 'folded')} THEN 'minutes' WHEN {_m(u.STATIC, 'folded')} THEN 'static' ELSE 'days' END AS ttl,
 CASE WHEN live THEN 'day' WHEN numeric OR event THEN 'week' END AS time_range, numeric, event, {_m(u.EVERGREEN, 'tlow')} AS evergreen, CASE WHEN trim(q) <> '' THEN trim(q) || ' ' || suffix END AS widened,
 {_m(u.LOCAL_MARKERS)} AS local, category, coalesce(CASE category {' '.join(f"WHEN '{c}' THEN '{k}'" for c, (k, _) in u.OSM_TAGS.items())} END, 'amenity') AS osm_key, CASE category {' '.join(f"WHEN '{c}' THEN '{v}'" for c, (_, v) in u.OSM_TAGS.items() if v)} END AS osm_value FROM w""")
def query_profile(spark, sf_dir):
    """X54, X72, X73, X76, X77, X81, X82, X85, X89, D07, D15, D16."""
    q = F.col("q")
    rows = _asked(spark, sf_dir).withColumns({"i": u.intent(q), "p": u.profile(q), "s": u.freshness_signal(q), "category": u.taxonomy(q)})
    tag = u.osm_tag(F.col("category"))
    return rows.select(
        "p_partkey", u.stripped(q).alias("stripped"), u.query_type(q).alias("type"), u.family(q).alias("family"), "i.depth", "i.freshness", "i.official_first", F.array_join(u.categories(q), ",").alias("categories"),
        "p.intent", "p.language", "p.freshness_required", F.array_join("p.entities", " ").alias("entities"), u.lifetime(q).alias("ttl"), "s.time_range", "s.numeric", "s.event", "s.evergreen", u.widened(q, F.col("s")).alias("widened"),
        u.is_local(q).alias("local"), "category", tag.key.alias("osm_key"), tag.value.alias("osm_value"),
    )



#: What _TEMPLATES come to: variants and parts, by place; others stay as they are.
_REWRITTEN = {
    0: ("what is {n}|what is {n} meaning definition", None), 1: ("so sánh {n} và {b}|{n}|{b}", "{n}|{b}"), 2: ("cách dùng {n} là gì|cách dùng {n} là gì nghĩa là|cách dùng {n} là gì ví dụ hướng dẫn", None), 3: ("latest news about {b}|latest news about {b} 2024", None),
    4: ("compare {n} vs {b}|{n}|{b}", "please compare {n}|{b}"), 5: ("giá vàng hôm nay|giá vàng hôm nay 2024", None), 6: ("python api error in {n}|python api error in {n} docs example", None), 7: ("{b} price today|{b} price today 2024", None),
    8: ("how to install {n} with docker|how to install {n} with docker example tutorial|how to install {n} with docker docs example", None), 12: (None, "review {b}|review {b} price"), 16: (None, "{n} design|{n} giá"), 17: ("luật {b}", None),
    23: ("explain c++x {n}?|explain c++x {n}? meaning definition|explain c++x {n}? docs example", None),
}


def _rewritten(k: int) -> str:
    def built(t: str) -> str:
        return "concat('" + t.replace("'", "''").replace("|", " | ").replace("{n}", "', replace(p_name, 'new', 'fresh'), '").replace("{b}", "', p_brand, '") + "')"

    cases = [f"WHEN {i} THEN {built(row[k])}" for i, row in _REWRITTEN.items() if row[k]]
    return f"CASE p_partkey % {len(_TEMPLATES)} {' '.join(cases)} ELSE q END"


@query("query_rewrites", f"WITH a AS ({_ASKED.replace('p_partkey, CASE', 'p_partkey, p_name, p_brand, CASE')}) SELECT p_partkey, q, {_rewritten(0)} AS variants, {_rewritten(1)} AS parts FROM a")
def query_rewrites(spark, sf_dir):
    """Variants and parts of every question, held to a plain version in the tests."""
    q = F.col("q")
    return _asked(spark, sf_dir).select("p_partkey", "q", F.array_join(u.rewrites(q, 2024), " | ").alias("variants"), F.array_join(u.decomposed(q), " | ").alias("parts"))
