"""Hashes, ids and forms that name records, passages and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

#: The namespace that point ids are made in. Fixed value.
POINTS = uuid.UUID("b5180cfc-a0f2-59f0-ba59-75fef1c9195c")
#: Parameters that only track, for pipeline_url. Fixed values.
PIPELINE_TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref source _ga mc_cid mc_eid igshid si feature ref_src ref_url".split()


def json_text(x: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _number(x: Column) -> Column:
    return F.coalesce(F.round(x, 6).cast("double").cast("string"), F.lit("null"))


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and blanks after commas and colons; the values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _tidy(x: Column, lower: bool = True) -> Column:
    t = F.trim(F.coalesce(x, F.lit("")))
    return json_text(F.lower(t) if lower else t)


def sha(x: Column) -> Column:
    return F.sha2(F.encode(x, "UTF-8"), 256)


def identity_hash(provider: Column, external_id: Column, name: Column, address: Column, lat: Column, lon: Column) -> Column:
    """By the provider's id, else by name, address and place."""
    by_id = _object({"p": json_text(provider), "e": json_text(external_id)})
    by_place = _object({"p": json_text(provider), "n": _tidy(name), "a": _tidy(address), "lat": _number(lat), "lon": _number(lon)})
    return sha(F.when(F.coalesce(external_id, F.lit("")) != "", by_id).otherwise(by_place))


def observation_hash(provider: Column, external_id: Column, name: Column, address: Column, phone: Column, website: Column, category: Column, status: Column, hours: Column, lat: Column, lon: Column) -> Column:
    """Every field that may change; hours: sorted JSON text or null."""
    fields = {"p": json_text(provider), "e": json_text(external_id), "n": _tidy(name), "a": _tidy(address), "ph": _tidy(phone, False), "w": _tidy(website), "c": _tidy(category), "s": _tidy(status)}
    return sha(_object(fields | {"h": F.coalesce(hours, F.lit("null")), "lat": _number(lat), "lon": _number(lon)}))


def point_id(passage_id: Column) -> Column:
    """A UUID of version 5 in POINTS, of the SHA-1 of namespace and id."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINTS.hex)), F.encode(passage_id, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def cache_key(query: Column, mode: Column, lang: Column, suffix: Column) -> Column:
    """X74."""
    words = F.array_join(F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: w != ""), " ")
    return sha(F.concat_ws(":", words, mode, lang, suffix))


def local_phone(phone: Column) -> Column:
    """Digits, with a written +84, 0084 or an 84 of eleven digits as 0."""
    d = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D+", "")
    plus = F.trim(phone).startswith("+") | (F.length(d) == 11)
    return F.when(d.startswith("0084"), F.concat(F.lit("0"), F.substring(d, 5, 1000))).when(d.startswith("84") & plus, F.concat(F.lit("0"), F.substring(d, 3, 1000))).otherwise(d)


def flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(text.fold(x), r"[^\p{L}\p{N}_]+", " "))


def match_forms(x: Column) -> Column:
    """The folded form with blanks and with hyphens, each once."""
    return F.array_distinct(F.filter(F.array(flat(x), F.replace(flat(x), F.lit(" "), F.lit("-"))), lambda f: f != ""))


def headed(heading_path: Column, chunk: Column) -> Column:
    """X86."""
    return F.when(F.size(heading_path) > 0, F.concat(F.lit("["), F.array_join(heading_path, " > "), F.lit("]\n\n"), chunk)).otherwise(chunk)


def robots_octets(path: Column) -> Column:
    """Every character but the unreserved as upper-case octets; encoded unreserved ones decoded. Octets of 80 and
    above stay octets, whether or not they are UTF-8."""
    mark = ""
    safe = F.regexp_replace(F.regexp_replace(path, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    pieces = F.split(F.regexp_replace(safe, r"%(?=[89A-Fa-f][0-9A-Fa-f])", mark), mark)
    upper = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1_000_000))))
    coded = F.url_encode(F.url_decode(F.array_join(upper, mark)))
    coded = F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(coded, F.lit("%EE%80%80"), F.lit("%"))


def without_publisher(title: Column, publisher: Column) -> Column:
    """X88."""
    tail = F.concat(F.lit(" - "), publisher)
    return F.when((F.coalesce(publisher, F.lit("")) != "") & title.endswith(tail), F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(tail)))).otherwise(title)


def pipeline_url(url: Column) -> Column:
    """Struct of canonical, domain, path, query and content_hash; null unless http or https with a host. The path
    is at least /, anchors that look like section ids stay, parameters are sorted."""
    u = F.trim(url)
    scheme = urls.scheme(u)
    net = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    net = F.when((scheme == "http") & net.endswith(":80"), F.regexp_replace(net, ":80$", "")).when((scheme == "https") & net.endswith(":443"), F.regexp_replace(net, ":443$", "")).otherwise(net)
    net = F.regexp_replace(net, r"^www\.", "")
    raw = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    path = F.when(raw.isin("", "/"), "/").otherwise(F.regexp_replace(raw, "/+$", ""))
    parts = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(parts, lambda p: ~name(p).isin(*PIPELINE_TRACKING) & ~name(p).startswith("utm_"))
    query = F.array_join(F.array_sort(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    anchor = F.regexp_extract(u, r"#([a-zA-Z0-9_-]+)$", 1)
    full = F.concat(scheme, F.lit("://"), net, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise(""))
    row = F.struct(full.alias("canonical"), net.alias("domain"), path.alias("path"), query.alias("query"), F.substring(sha(full), 1, 16).alias("content_hash"))
    return F.when(scheme.isin("http", "https") & (net != ""), row)
