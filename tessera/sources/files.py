"""File sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRAPER = "place_id string, cid string, data_id string, link string, title string, address string, complete_address struct<street:string,borough:string,city:string,state:string,country:string>, latitude double, longitude double, longtitude double, phone string, web_site string, category string, categories array<string>, open_hours map<string,array<string>>, review_rating double, review_count long, price_range string, business_status string, permanently_closed boolean, _corrupt string"
#: Tags that make an element a point of interest, in order. Fixed values.
POI_KEYS = ("amenity", "shop", "tourism", "office", "leisure", "healthcare", "craft")


def scraper_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; bad lines stay as rows with _corrupt."""
    return spark.read.schema(SCRAPER).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def scraper_records(rows: DataFrame) -> DataFrame:
    """Identity place_id > cid > data_id > link; the address from its parts if it isn't given."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    parts = F.concat_ws(", ", *[F.col(f"complete_address.{p}") for p in ("street", "borough", "city", "state", "country")])
    return rows.select(
        F.coalesce(*map(full, ("place_id", "cid", "data_id", "link"))).alias("external_id"), F.col("title").alias("raw_name"), F.coalesce(full("address"), F.nullif(parts, F.lit(""))).alias("raw_address"), F.col("phone").alias("raw_phone"), F.col("web_site").alias("raw_website"),
        F.coalesce(full("category"), F.try_element_at("categories", F.lit(1))).alias("raw_category"), F.col("latitude").alias("lat"), F.coalesce("longitude", "longtitude").alias("lon"),
        F.when(F.col("permanently_closed"), "permanently_closed").otherwise(F.col("business_status")).alias("raw_status"), F.col("_corrupt").isNotNull().alias("parse_error"),
    )


def poi_category(tags: Column) -> Column:
    """Key:value of the first key that has a value."""
    return F.coalesce(*[F.when(F.try_element_at(tags, F.lit(k)) != "", F.concat(F.lit(f"{k}:"), F.try_element_at(tags, F.lit(k)))) for k in POI_KEYS])


def lifecycle_status(tags: Column) -> Column:
    """S14."""
    return F.when(F.exists(F.map_keys(tags), lambda k: k.startswith("disused:") | k.startswith("abandoned:")), "permanently_closed")


def way_centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (way_id, refs array), nodes (node_id, lat, lon): each way's mean position."""
    refs = ways.select("way_id", F.explode(F.array_distinct("refs")).alias("node_id"))
    return refs.join(nodes, "node_id").groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def unsafe_xml(xml: Column) -> Column:
    return xml.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)")


def sitemap_urls(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Loc, lastmod and kind (url or sitemap) of each entry; documents with a DOCTYPE or ENTITY give none."""
    entry = r"(?is)<(url|sitemap)\b[^>]*>(.*?)</\1>"
    blocks = F.arrays_zip(F.regexp_extract_all(xml, F.lit(entry), F.lit(1)).alias("kind"), F.regexp_extract_all(xml, F.lit(entry), F.lit(2)).alias("body"))
    rows = docs.where(~unsafe_xml(F.col(xml))).withColumn("__b", F.explode(blocks))
    inner = lambda tag: F.nullif(F.trim(F.regexp_extract(F.col("__b.body"), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return rows.select(*docs.columns, F.lower("__b.kind").alias("kind"), inner("loc").alias("loc"), inner("lastmod").alias("lastmod")).drop(xml).where("loc is not null")


def feed_items(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, link and published of RSS items and Atom entries (link rel=alternate before others)."""
    entry = r"(?is)<(item|entry)\b[^>]*>(.*?)</\1>"
    rows = docs.where(~unsafe_xml(F.col(xml))).withColumn("__b", F.explode(F.regexp_extract_all(xml, F.lit(entry), F.lit(2))))
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.col("__b"), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", "")), F.lit(""))
    alternate = F.nullif(F.regexp_extract("__b", r"""(?is)<link\b(?=[^>]*rel=["']alternate)[^>]*href=["']([^"']+)""", 1), F.lit(""))
    some = F.nullif(F.regexp_extract("__b", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit(""))
    return rows.select(*[c for c in docs.columns if c != xml], inner("title").alias("title"), F.coalesce(inner("link"), alternate, some).alias("link"), F.coalesce(inner("pubDate"), inner("published"), inner("updated")).alias("published"))


def feed_time(raw: Column) -> Column:
    """RFC 822 or ISO 8601 as a timestamp; else null."""
    day = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(raw))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """The units of a JSON seed, a row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("units").alias("u")).select("u.*")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of queries with expectations."""
    return spark.read.schema("query string, expected_urls array<string>, category string, region string, time_sensitive boolean, expected_facts array<string>").json(path)
