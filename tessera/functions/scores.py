"""Time decays and composite scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives of freshness by lane, in days. Fixed values.
HALF_LIVES = {
    "market": 0.25, "finance": 1.0, "news": 2.0, "social": 14.0, "forum": 30.0, "ecommerce": 14.0, "product": 45.0, "business": 60.0, "company": 90.0, "places": 180.0,
    "medical": 730.0, "document": 1825.0, "legal": 3650.0, "government": 3650.0, "academic": 3650.0,
}
#: Decay times of recency by field, in days. Fixed values.
DECAY_DAYS = {"hours": 45.0, "status": 45.0, "phone": 180.0, "website": 180.0, "category": 365.0, "name": 730.0, "address": 730.0, "location": 1460.0}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: least and greatest would pass over it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(default))


def age_days(then: Column, now: Column) -> Column:
    """Not below 0; null without a time."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400e6))


def freshness(published: Column, now: Column, lane: Column | None = None) -> Column:
    """1 - age / (2 half-lives) by lane, over five years without a known lane; .5 without a date."""
    span = F.lit(365.25 * 5) if lane is None else lookup({k: 2 * v for k, v in HALF_LIVES.items()}, F.coalesce(lane, F.lit("")), 365.25 * 5)
    return F.coalesce(clamp(1 - age_days(published, now) / span), F.lit(0.5))


def recency(observed: Column, now: Column, field: Column) -> Column:
    """D03."""
    return F.coalesce(F.exp(-age_days(observed, now) / lookup(DECAY_DAYS, field, 180.0)), F.lit(0.5))


def projection_freshness(seen: Column, now: Column) -> Column:
    """D04."""
    return F.coalesce(F.exp(-age_days(seen, now) / 180), F.lit(0.5))


def recrawl_hours(change_rate: Column) -> Column:
    """From seven days for what never changes to an hour."""
    return F.lit(168.0) - change_rate * 167.0


def backoff_minutes(failures: Column) -> Column:
    """D12."""
    return F.least((failures + 1) * 10, F.lit(720))


def bayesian_rating(rating: Column, reviews: Column) -> Column:
    """Smoothed towards 3.5 by ten reviews, over 5."""
    n = F.greatest(F.coalesce(reviews.cast("double"), F.lit(0.0)), F.lit(0.0))
    return clamp((F.coalesce(rating, F.lit(3.5)) * n + 35.0) / (n + 10.0) / 5.0)


def popularity(reviews: Column) -> Column:
    """M07."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(reviews.cast("double"), F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(1000.0)))


def quality_v1(relevance: Column, authority: Column, fresh: Column, penalty: Column, geo: Column) -> Column:
    """M08."""
    return clamp(0.35 * clamp(relevance) + 0.25 * authority + 0.25 * fresh - 0.10 * penalty + 0.05 * geo)


def quality_v2(semantic: Column, rrf: Column, source: Column, fresh: Column, covered: Column, content: Column) -> Column:
    """M09."""
    return clamp(0.40 * clamp(semantic) + 0.20 * clamp(rrf) + 0.15 * source + 0.10 * fresh + 0.10 * clamp(covered) + 0.05 * clamp(content))


def field_weight(authority: Column, recent: Column, corroboration: Column) -> Column:
    """A05, before rounding to four places."""
    return 0.6 * authority + 0.3 * recent + 0.1 * corroboration


def ema(values: Column, alpha: float = 0.3, start: float = 0.0) -> Column:
    """The exponential average along an array."""
    return F.aggregate(values, F.lit(start), lambda acc, x: acc * (1 - alpha) + x.cast("double") * alpha)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def rounded_index(values: Column, p: float) -> Column:
    """Of a sorted array, the element at p x (n - 1) rounded half to even."""
    return F.try_element_at(values, F.bround(F.lit(p) * (F.size(values) - 1)).cast("int") + 1)


def content_depth(content_length: Column, description: Column) -> Column:
    """Of 4,000 characters of what was fetched, else of the description."""
    n = F.coalesce(F.nullif(F.greatest(F.coalesce(content_length.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.length(F.coalesce(description, F.lit(""))).cast("double"))
    return clamp(n / 4000)


#: Authority by host in the older score. Fixed values.
LEGACY_AUTHORITY = {
    "chinhphu.vn": 0.98, "luatvietnam.vn": 0.85, "thuvienphapluat.vn": 0.85, "congan.bacgiang.gov.vn": 0.95, "cand.com.vn": 0.88, "baobacgiang.vn": 0.82, "vnexpress.net": 0.80, "tuoitre.vn": 0.80, "dantri.com.vn": 0.80, "thanhnien.vn": 0.78, "vietnamnet.vn": 0.78,
    "github.com": 0.85, "docs.python.org": 0.90, "stackoverflow.com": 0.60, "facebook.com": 0.25, "twitter.com": 0.25, "reddit.com": 0.40, "tiktok.com": 0.20, "unknown": 0.12,
}


def legacy_source(relevance: Column, url: Column, query: Column, title: Column, description: Column) -> Column:
    """.30 relevance + .25 authority + .20 x .5 freshness + .15 (.7 title + .3 description overlap)."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""))
    q = words(query)
    share = lambda x: F.size(F.array_intersect(q, words(x))) / F.greatest(F.size(q), F.lit(1))
    host = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    return relevance * 0.30 + lookup(LEGACY_AUTHORITY, host, 0.12) * 0.25 + 0.5 * 0.20 + (share(title) * 0.7 + share(description) * 0.3) * 0.15


def cost(explicit: Column, default: float) -> Column:
    """A42, an aggregate: the explicit costs and the default for the others."""
    return F.round(F.sum(F.coalesce(explicit.cast("double"), F.lit(default))), 6)
