"""URL scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track. Fixed values.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid dclid mc_cid mc_eid igshid ref ref_src spm".split()
#: Second levels under which a name is registered. Fixed values.
SECOND_LEVELS = "com net org gov edu co ac info biz".split()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def parameters(url: Column) -> Column:
    """The query's parts that don't only track, sorted."""
    parts = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    return F.array_sort(F.filter(parts, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))


def canonical_url(url: Column) -> Column:
    """Host without www. or m., no fragment, tracking or trailing slash, parameters sorted, scheme kept."""
    h = F.regexp_replace(host(url), r"^(?:www\.|m\.)", "")
    q = F.array_join(parameters(url), "&")
    base = F.concat(scheme(url), F.lit("://"), h, F.regexp_replace(path(url), r"/+$", ""))
    return F.when(host(url) == "", F.trim(url)).otherwise(F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def identity(url: Column) -> Column:
    """The canonical form without its scheme."""
    return F.regexp_replace(canonical_url(url), r"^[a-z][a-z0-9+.-]*://", "")


def eval_url(url: Column) -> Column:
    """Http and https alike, lower case, no www., fragment or trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, r"#.*$", "")), r"^https?://(?:www\.)?", ""), r"/+$", "")


def normalize_domain(domain: Column) -> Column:
    """X21."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^(?:www\.)+", ""), r"\.+$", "")


def registrable_domain(h: Column) -> Column:
    """The last two labels, three under a two-letter ending with a known second level."""
    labels = F.split(normalize_domain(h), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVELS)
    return F.array_join(F.slice(labels, F.greatest(n - F.when(deep, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")


def canonical_website(raw: Column) -> Column:
    """Lower scheme and host, no query, fragment or trailing slash; null without a host."""
    full = F.when(F.trim(raw).contains("://"), F.trim(raw)).otherwise(F.concat(F.lit("https://"), F.trim(raw)))
    net = F.lower(F.regexp_extract(full, r"^[^:]*://([^/?#]*)", 1))
    return F.when((F.trim(F.coalesce(raw, F.lit(""))) != "") & (net != ""), F.concat(F.coalesce(F.nullif(scheme(full), F.lit("")), F.lit("https")), F.lit("://"), net, F.regexp_replace(path(full), r"/+$", "")))


def website_domain(raw: Column) -> Column:
    """X10."""
    return F.regexp_replace(F.regexp_extract(canonical_website(raw), r"^[^:]*://([^/]*)", 1), r"^www\.", "")


def private_host(h: Column) -> Column:
    """hosts inside a network, by name or by literal address."""
    return h.rlike(r"^(?:localhost|0\.0\.0\.0|\[?::1\]?|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)|\.(?:local|internal|localhost)$")


def spam_score(h: Column, p: Column) -> Column:
    """.5 for an indicator word, .1 for each level of the path over 5, .2 for a suspicious ending."""
    depth = F.size(F.split(p, "/")) - 1
    return F.concat_ws("/", h, p).rlike(r"casino|viagra|porn|bet365|loan-|free-money").cast("double") * 0.5 + F.greatest(depth - 5, F.lit(0)) * 0.1 + h.rlike(r"\.(?:xyz|top|click|loan|win|bid|tk|ml|ga|cf)$").cast("double") * 0.2
