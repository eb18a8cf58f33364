"""From fetched bodies to documents: extractors, tiers, embeddings, place candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import files, pages

#: Metadata that marks a page as a place's. Fixed values.
PLACE_KEYS = ("telephone", "address", "geo", "latitude", "openingHours")


def main_content(html: Column) -> Column:
    """Struct of title, text, author, published, description, language and word_count from the markup alone: the article
    or main element if there is one, without navigation, headers, footers, asides and forms."""
    meta = lambda *names: F.nullif(F.coalesce(*[F.nullif(F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']{n}["'][^>]*content\s*=\s*["']([^"']*)""", 1), F.lit("")) for n in names]), F.lit(""))
    core = F.coalesce(*[F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*)</{t}>", 1), F.lit("")) for t in ("article", "main", "body")], html)
    bare = F.regexp_replace(core, r"(?is)<(nav|header|footer|aside|form)\b.*?</\1\s*>", " ")
    body = pages.visible_text(bare)
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    return F.struct(F.coalesce(meta("og:title"), F.nullif(pages.title(html), F.lit(""))).alias("title"), body.alias("text"), meta("author", "article:author").alias("author"), meta("article:published_time", "date").alias("published"), meta("description", "og:description").alias("description"), F.nullif(pages.html_language(html), F.lit("")).alias("language"), words.alias("word_count"))


def raw_text(content: Column) -> Column:
    """The text as it is; the first markdown heading of its first 2,000 characters is the title."""
    body = F.trim(content)
    none = F.lit(None).cast("string")
    return F.struct(F.nullif(F.trim(F.regexp_extract(F.substring(body, 1, 2000), r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit("")).alias("title"), body.alias("text"), none.alias("author"), none.alias("published"), none.alias("description"), none.alias("language"), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("word_count"))


#: Extractors by the beginning of the MIME type; add to it to extend.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {"text/html": main_content, "application/xhtml": main_content, "text/": raw_text, "application/json": raw_text}


def extracted(bodies: DataFrame, content: str = "body", mime: str = "mime") -> DataFrame:
    """Bodies with `doc` by the first extractor that takes their type; null for other types and empty bodies."""
    out = None
    for prefix, how in EXTRACTORS.items():
        test = F.lower(F.coalesce(mime, F.lit(""))).startswith(prefix)
        out = F.when(test, how(F.col(content))) if out is None else out.when(test, how(F.col(content)))
    return bodies.withColumn("doc", F.when(F.trim(F.coalesce(content, F.lit(""))) != "", out))


def fetch_status(code: Column, content_length: Column, most: int = 10 * 1024 * 1024) -> Column:
    """What a fetch came to: not_modified, ok, too_large, gone, blocked, rate_limited, redirect, server_error or failed."""
    return (
        F.when(code.isNull(), "failed").when(code == 304, "not_modified").when(code.between(200, 299) & (F.coalesce(content_length, F.lit(0)) > most), "too_large").when(code.between(200, 299), "ok").when(code.isin(404, 410), "gone")
        .when(code.isin(401, 403), "blocked").when(code == 429, "rate_limited").when(code.between(300, 399), "redirect").when(code >= 500, "server_error").otherwise("failed")
    )


def tiered(urls: DataFrame, tiers: list[tuple[str, DataFrame]], least_words: int = 40) -> DataFrame:
    """Urls (url) and tables of what each tier read (url, text), in order: the first tier whose text has
    `least_words` words, else the first with any, marked degraded."""
    out = urls
    for name, rows in tiers:
        out = out.join(rows.select("url", F.col("text").alias(f"__{name}")), "url", "left")
    n = lambda c: F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    names = [t for t, _ in tiers]
    good = F.coalesce(*[F.when(n(F.col(f"__{t}")) >= least_words, F.lit(t)) for t in names])
    some = F.coalesce(*[F.when(n(F.col(f"__{t}")) > 0, F.lit(t)) for t in names])
    tier = F.coalesce(good, some)
    body = F.coalesce(*[F.when(tier == t, F.col(f"__{t}")) for t in names])
    return out.select("url", tier.alias("tier"), body.alias("text"), (good.isNull() & some.isNotNull()).alias("degraded"))


def site_urls(pages_: DataFrame, domain: str, limit: int | None = None) -> DataFrame:
    """The distinct addresses of a site among fetched pages and their links, in order."""
    found = pages_.select("url").unionByName(pages.links(pages_).select(pages.absolute(F.col("url"), F.col("href")).alias("url")))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
    rows = found.where((host == domain) | host.endswith("." + domain)).distinct().orderBy("url")
    return rows if limit is None else rows.limit(limit)


def sitemap_tree(fetched: DataFrame, roots: DataFrame, depth: int = 3, most: int = 10_000) -> DataFrame:
    """Fetched (url, xml) sitemaps, roots (url): the page addresses that the roots' indexes lead to within `depth`
    levels, each sitemap once; `most` for each root."""
    entries = files.sitemap_urls(fetched)
    front = roots.select(F.col("url").alias("root"), "url")
    seen, found = front, None
    for level in range(depth + 1):
        here = front.join(entries, "url")
        urls = here.where("kind = 'url'").select("root", F.col("loc").alias("url"), F.lit(level).alias("depth"))
        found = urls if found is None else found.unionByName(urls)
        front = here.where("kind = 'sitemap'").select("root", F.col("loc").alias("url")).distinct().join(seen, ["root", "url"], "left_anti")
        if level == depth or front.isEmpty():
            break
        seen = seen.unionByName(front)
    from ..operators.retrieval import top_k

    return top_k(found.groupBy("root", "url").agg(F.min("depth").alias("depth")), most, ["root"], F.col("depth"), F.col("url")).drop("rank")


def place_candidates(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, canonical_url, title, metadata: JSON) whose metadata shows a place, as raw records."""
    at = lambda p: F.nullif(F.get_json_object("metadata", f"$.{p}"), F.lit(""))
    name = F.coalesce(at("name"), F.nullif("title", F.lit("")))
    parts = F.nullif(F.concat_ws(", ", at("address.streetAddress"), at("address.addressLocality"), at("address.addressRegion")), F.lit(""))
    plain = F.when(~at("address").startswith("{"), at("address"))
    signal = F.coalesce(*[at(k) for k in PLACE_KEYS]).isNotNull()
    rows = documents.where(signal & name.isNotNull())
    number = lambda *p: F.coalesce(*[at(x) for x in p]).try_cast("double")
    return rows.select(
        F.col("doc_id").cast("string").alias("external_id"), F.col("canonical_url").alias("source_url"), name.alias("raw_name"), F.coalesce(plain, parts).alias("raw_address"), at("telephone").alias("raw_phone"), F.col("canonical_url").alias("raw_website"),
        F.coalesce(F.get_json_object("metadata", "$['@type']"), at("category")).alias("raw_category"), number("latitude", "geo.latitude").alias("lat"), number("longitude", "geo.longitude").alias("lon"), F.col("metadata").alias("raw_payload"),
    )


def pois_around(pois: DataFrame, lat: float, lon: float, radius_km: float, key: str, value: str | None = None, limit: int = 50) -> DataFrame:
    """Points (name, tags map, lat, lon) with a tag within a radius, nearest first; a box reaches the scan."""
    import math

    dy = radius_km / 111.0 * 1.01
    dx = dy / max(math.cos(math.radians(lat)), 0.05)
    tag = F.try_element_at("tags", F.lit(key))
    rows = pois.where(F.col("lat").between(lat - dy, lat + dy) & F.col("lon").between(lon - dx, lon + dx)).where(tag.isNotNull() if value is None else tag == value)
    d = geo.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return rows.withColumn("distance_m", d).where(F.col("distance_m") <= radius_km * 1000).orderBy("distance_m", "name").limit(limit)


def arxiv_entries(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, url, summary and published of an Atom answer's entries."""
    rows = docs.where(~files.unsafe_xml(F.col(xml))).select(*[c for c in docs.columns if c != xml], F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))).alias("pos", "e"))
    tidy = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"\s+", " ")), F.lit(""))
    return rows.select(*[c for c in docs.columns if c != xml], "pos", tidy("title").alias("title"), tidy("id").alias("url"), tidy("summary").alias("snippet"), tidy("published").alias("published_at")).where("url is not null")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a JSON file."""
    one = "struct<query_id:string,query:string,lang:string,intent:string,relevant_urls:array<string>,gold_answer:string,gold_facts:array<string>,freshness_class:string,mode:string>"
    return spark.read.schema(f"queries array<{one}>").option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def embedded(text: Column, model: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors of texts by a model that takes a list of them, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()), index=s.index)

    return run(text)


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in where no model is at hand: signed hashes of words, of length 1."""

    def run(texts: list[str]) -> list[list[float]]:
        import math
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x8000_0000 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return run


def pair_scores(query: Column, text: Column, model: Callable[[list[str], list[str]], list[float] | None]) -> Column:
    """Scores from 0 to 1 of pairs by a model; where it gives None, the share of the query's words in the text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            q, t = q.fillna(""), t.fillna("")
            got = model(q.tolist(), t.tolist())
            if got is None:
                got = [len(set(a.lower().split()) & set(b.lower().split())) / max(len(set(a.lower().split())), 1) for a, b in zip(q, t, strict=True)]
            yield pd.Series(got, index=q.index).clip(0.0, 1.0)

    return run(query, text)


def register_sql(spark: SparkSession) -> None:
    """SQL functions json_float(v) and identity_canon(provider, external_id, name, address, lat, lon)."""
    text_of = "substring(to_json(struct({0} AS v)), 6, length(to_json(struct({0} AS v))) - 6)"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION json_float(v DOUBLE) RETURNS STRING RETURN coalesce(CAST(round(v, 6) AS STRING), 'null')")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION identity_canon(provider STRING, external_id STRING, name STRING, address STRING, lat DOUBLE, lon DOUBLE) RETURNS STRING RETURN
        CASE WHEN external_id IS NOT NULL THEN concat('{{"e": ', {text_of.format('external_id')}, ', "p": ', {text_of.format('provider')}, '}}')
        ELSE concat('{{"a": ', {text_of.format("trim(lower(coalesce(address, '')))")}, ', "lat": ', json_float(lat), ', "lon": ', json_float(lon), ', "n": ', {text_of.format("trim(lower(coalesce(name, '')))")}, ', "p": ', {text_of.format('provider')}, '}}') END"""
    )
