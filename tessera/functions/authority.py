"""Authority, type and trust of web domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types with a score of their own where nothing better is known. Fixed values.
SCORES = {
    "official": 1.0, "government": 1.0, "research_paper": 0.95, "major_publication": 0.9, "vendor_website": 0.85, "specialist_blog": 0.75, "forum": 0.6, "reddit": 0.55, "unknown_seo_site": 0.3,
}
#: Known domains: type and score, subdomains included; the first that fits counts. Fixed values.
DOMAINS = {
    "vnexpress.net": ("major_publication", 0.88), "tuoitre.vn": ("major_publication", 0.88), "thanhnien.vn": ("major_publication", 0.88), "dantri.com.vn": ("major_publication", 0.85), "zingnews.vn": ("major_publication", 0.85),
    "vietnamnet.vn": ("major_publication", 0.85), "kenh14.vn": ("major_publication", 0.72), "cafef.vn": ("major_publication", 0.75), "cafebiz.vn": ("major_publication", 0.75), "nld.com.vn": ("major_publication", 0.85),
    "nhandan.vn": ("major_publication", 0.9), "qdnd.vn": ("major_publication", 0.85), "vtv.vn": ("major_publication", 0.85), "laodong.vn": ("major_publication", 0.85), "baomoi.com": ("major_publication", 0.8), "voh.com.vn": ("major_publication", 0.8),
    "sjc.com.vn": ("vendor_website", 0.9), "btmc.vn": ("vendor_website", 0.85), "phuquy.com.vn": ("vendor_website", 0.85), "pnj.com.vn": ("vendor_website", 0.9), "doji.vn": ("vendor_website", 0.85),
    "chinhphu.vn": ("government", 1.0), "baochinhphu.vn": ("government", 1.0), "vietnam.gov.vn": ("government", 1.0), "mof.gov.vn": ("government", 1.0),
    "foody.vn": ("specialist_blog", 0.72), "lozi.vn": ("specialist_blog", 0.72), "mytour.vn": ("specialist_blog", 0.72), "toplist.vn": ("specialist_blog", 0.7), "amthucbinhxuyen.com": ("specialist_blog", 0.72),
    "reuters.com": ("major_publication", 0.9), "apnews.com": ("major_publication", 0.9), "bloomberg.com": ("major_publication", 0.9), "nytimes.com": ("major_publication", 0.9), "theguardian.com": ("major_publication", 0.9),
    "washingtonpost.com": ("major_publication", 0.9), "ft.com": ("major_publication", 0.9), "cnn.com": ("major_publication", 0.72), "techcrunch.com": ("major_publication", 0.75),
    "arxiv.org": ("research_paper", 0.95), "ieee.org": ("research_paper", 0.95), "papers.ssrn.com": ("research_paper", 0.95), "pubmed.ncbi.nlm.nih.gov": ("research_paper", 0.95),
    "github.com": ("vendor_website", 0.85), "openai.com": ("vendor_website", 0.85), "developer.mozilla.org": ("official", 1.0), "docs.docker.com": ("official", 1.0), "wikipedia.org": ("major_publication", 0.8),
    "stackoverflow.com": ("forum", 0.6), "reddit.com": ("reddit", 0.55), "quora.com": ("specialist_blog", 0.55), "medium.com": ("specialist_blog", 0.75), "substack.com": ("specialist_blog", 0.75),
    "vbpl.vn": ("government", 1.0), "vanban.chinhphu.vn": ("government", 1.0), "congbao.chinhphu.vn": ("government", 1.0), "xaydungchinhsach.chinhphu.vn": ("government", 1.0), "thuvienphapluat.vn": ("major_publication", 0.85),
    "luatvietnam.vn": ("major_publication", 0.8), "vietnamplus.vn": ("major_publication", 0.9), "congthuong.vn": ("major_publication", 0.8), "vietstock.vn": ("major_publication", 0.75), "tinnhanhchungkhoan.vn": ("major_publication", 0.75), "vneconomy.vn": ("major_publication", 0.78),
    "otofun.net": ("forum", 0.55), "vozforums.com": ("forum", 0.55), "webtretho.com": ("forum", 0.5), "tinhte.vn": ("specialist_blog", 0.7),
    "thegioididong.com": ("vendor_website", 0.8), "cellphones.com.vn": ("vendor_website", 0.8), "fptshop.com.vn": ("vendor_website", 0.8), "shopee.vn": ("vendor_website", 0.72), "tiki.vn": ("vendor_website", 0.72), "lazada.vn": ("vendor_website", 0.7),
}
#: Scores in a lane. Fixed values.
VERTICALS = {
    "vbpl.vn": {"legal": 1.0, "government": 1.0, "document": 1.0, "news": 0.6},
    "vanban.chinhphu.vn": {"legal": 1.0, "government": 1.0, "document": 1.0, "news": 0.6},
    "congbao.chinhphu.vn": {"legal": 1.0, "government": 1.0, "document": 1.0, "news": 0.6},
    "xaydungchinhsach.chinhphu.vn": {"legal": 1.0, "government": 1.0, "document": 1.0, "news": 0.75},
    "thuvienphapluat.vn": {"legal": 0.92, "government": 0.85, "document": 0.9, "news": 0.5},
    "luatvietnam.vn": {"legal": 0.88, "government": 0.8, "document": 0.85, "news": 0.5},
    "nhandan.vn": {"government": 0.95, "administrative": 0.9, "legal": 0.8, "news": 0.9},
    "vietnamplus.vn": {"government": 0.9, "administrative": 0.85, "legal": 0.75, "news": 0.88},
    "congthuong.vn": {"business": 0.85, "market": 0.85, "news": 0.75},
    "cafef.vn": {"market": 0.85, "finance": 0.8, "business": 0.75, "news": 0.65},
    "vneconomy.vn": {"market": 0.82, "finance": 0.8, "business": 0.78, "news": 0.65},
    "vietstock.vn": {"market": 0.85, "finance": 0.85, "business": 0.75, "news": 0.6},
    "tinnhanhchungkhoan.vn": {"market": 0.85, "finance": 0.8, "news": 0.6},
    "sjc.com.vn": {"market": 0.95, "product": 0.9, "ecommerce": 0.7},
    "pnj.com.vn": {"market": 0.92, "product": 0.9, "ecommerce": 0.7},
    "doji.vn": {"market": 0.9, "product": 0.85, "ecommerce": 0.7},
    "foody.vn": {"places": 0.85, "business": 0.7, "news": 0.4},
    "tripadvisor.com": {"places": 0.8, "news": 0.3},
    "thegioididong.com": {"product": 0.85, "ecommerce": 0.8, "news": 0.4},
    "cellphones.com.vn": {"product": 0.85, "ecommerce": 0.8, "news": 0.4},
    "fptshop.com.vn": {"product": 0.82, "ecommerce": 0.78, "news": 0.4},
    "shopee.vn": {"ecommerce": 0.72, "product": 0.6, "news": 0.25},
    "tiki.vn": {"ecommerce": 0.72, "product": 0.6, "news": 0.25},
    "lazada.vn": {"ecommerce": 0.7, "product": 0.55, "news": 0.25},
    "otofun.net": {"forum": 0.7, "product": 0.7, "social": 0.6, "legal": 0.1, "government": 0.1},
    "vozforums.com": {"forum": 0.65, "social": 0.6, "product": 0.55, "legal": 0.1},
    "webtretho.com": {"forum": 0.6, "social": 0.55, "product": 0.5, "legal": 0.1},
    "tinhte.vn": {"product": 0.75, "forum": 0.65, "news": 0.5, "legal": 0.15},
    "reddit.com": {"forum": 0.55, "social": 0.55, "legal": 0.15, "government": 0.1},
}
#: Well-known platforms, content farms, patterns of farms and of low-value pages. Fixed values.
FAMOUS = (
    "foody.vn", "pasgo.vn", "lozi.vn", "vietnamnet.vn", "vnexpress.net", "dantri.com.vn", "zingnews.vn", "thanhnien.vn", "tuoitre.vn", "baomoi.com", "thegioididong.com", "shopee.vn", "tiki.vn",
    "google.com", "maps.google.com", "facebook.com", "instagram.com", "youtube.com", "tripadvisor.com", "booking.com", "agoda.com", "now.vn", "baemin.vn", "shopeefood.vn", "grabfood.vn",
)
FARMS = ("giatot24gio.com", "hoclaixetphcm.com")
FARM_PATTERN = r"(giatot|24h|24gio|nhanh|pro|top[0-9]+|seo)"
LOW_VALUE = r"(bokep|porn|xvideo|xxx|hentai|casino|bong88|lode|f88|vaytien|taichinh24h|nokiavn|clipnong)"
#: Trust by type. Fixed values.
TRUST = {"official": "high", "government": "high", "research_paper": "high", "major_publication": "high", "vendor_website": "medium", "specialist_blog": "medium", "forum": "medium", "reddit": "low", "unknown_seo_site": "unverified"}


def host_of(domain: Column) -> Column:
    """A domain or URL as a bare lower-case host without www. and port."""
    d = F.trim(F.trim(F.lower(domain)), F.lit("."))
    d = F.when(d.contains("://"), F.regexp_extract(d, r"://([^/?#]*)", 1)).otherwise(d)
    return F.split(F.regexp_replace(d, r"^www\.", ""), ":")[0]


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _first(host: Column, table: dict[str, Column]) -> Column:
    """What the first key of the table gives that is the host or a parent of it; null if none is."""
    places = F.create_map(*[F.lit(x) for i, k in enumerate(table) for x in (k, i + 1)])
    return F.try_element_at(F.array(*table.values()), F.array_min(F.transform(_suffixes(host), lambda s: F.try_element_at(places, s))))


def _registry(host: Column) -> Column:
    """gov, edu and mil at the end, or gov and edu before the country."""
    labels = F.split(host, r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return last.isin("gov", "edu", "mil") | F.coalesce(before.isin("gov", "edu"), F.lit(False))


def _farm(host: Column) -> Column:
    return host.isin(*FARMS) | host.rlike(FARM_PATTERN)


def source_type(domain: Column) -> Column:
    """X68."""
    h = host_of(domain)
    kinds = _first(h, {k: F.lit(t) for k, (t, _) in DOMAINS.items()})
    registry = F.when(F.array_contains(F.split(h, r"\."), "gov"), "government").otherwise("research_paper")
    return (
        F.when(_registry(h), registry).when((F.split(h, r"\.")[0] == "docs") & ~_farm(h), "official").when(kinds.isNotNull(), kinds)
        .when(_farm(h), "unknown_seo_site").when(h.endswith(".vn"), "specialist_blog").otherwise("unknown_seo_site")
    )


def base_authority(domain: Column) -> Column:
    h = host_of(domain)
    score = _first(h, {k: F.lit(s) for k, (_, s) in DOMAINS.items()})
    return F.when(_registry(h), 1.0).when((F.split(h, r"\.")[0] == "docs") & ~_farm(h), 0.85).when(score.isNotNull(), score).when(_farm(h), 0.18).when(h.endswith(".vn"), 0.7).otherwise(SCORES["unknown_seo_site"])


def local_boost(domain: Column) -> Column:
    """1.5 for .vn, 1.0 for a well-known platform, the larger of both."""
    h = host_of(domain)
    known = F.arrays_overlap(_suffixes(h), F.array(*map(F.lit, FAMOUS)))
    return F.greatest(F.when(h.endswith(".vn"), 1.5).otherwise(0.0), F.when(known, 1.0).otherwise(0.0))


def authority(domain: Column, vertical: Column | None = None, lang: Column | None = None) -> Column:
    """A lane's own score, else the base score; the local boost on top for Vietnamese."""
    score = base_authority(domain)
    if vertical is not None:
        lanes = _first(host_of(domain), {k: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) for k, v in VERTICALS.items()})
        score = F.coalesce(F.try_element_at(lanes, F.coalesce(vertical, F.lit(""))), score)
    if lang is not None:
        score = score + F.when(F.lower(lang).startswith("vi"), local_boost(domain)).otherwise(0.0)
    return score


def trust(url: Column, host: Column, providers: Column) -> Column:
    """Struct of type, score and trust. Two providers lift to medium; low-value patterns in the URL lower."""
    kind = source_type(host)
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), kind)
    agreed = F.when((F.size(F.array_distinct(providers)) >= 2) & by_type.isin("unverified", "low"), "medium").otherwise(by_type)
    level = F.when(F.lower(url).rlike(LOW_VALUE), "low").otherwise(agreed)
    empty = host.isNull() | (host == "")
    return F.struct(F.when(~empty, kind).alias("type"), F.when(~empty, F.round(authority(host), 3)).alias("score"), F.when(empty, "unverified").otherwise(level).alias("trust"))


def effective(base: Column, precision: Column) -> Column:
    """Blended with the observed precision of citations."""
    return 0.7 * base + 0.3 * precision
