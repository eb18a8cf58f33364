"""The serving projection: canonical places, their sources and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload, scores, text

STATUSES = ("open", "temporarily_closed", "permanently_closed", "unknown")
VOLATILE = ("open_now", "map_url")


def alias_rows(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links (place_id, record_id) with the raw names of their records."""
    return links.join(records.select("record_id", "raw_name"), "record_id").select("place_id", "raw_name")


def aliases(names: DataFrame) -> DataFrame:
    """names (place_id, raw_name): distinct names, blind to case and outer blanks, sorted. Of equal ones the first in
    code-point order stands. One combining pass: a place's names meet as a set, not as its links."""
    rows = names.select("place_id", F.trim(F.coalesce("raw_name", F.lit(""))).alias("name")).where("name <> ''")
    each = rows.groupBy("place_id", F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    return each.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("name", "low"))).alias("__names"))


def project(places: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """canonical places as serving documents, with the aliases among names (place_id, raw_name) that differ from the
    place's own names."""
    c = F.col
    own = F.array(F.lower(F.trim(F.coalesce("canonical_name", F.lit("")))), F.lower(F.trim(F.coalesce("normalized_name", F.lit("")))))
    images = F.coalesce(F.from_json("images", "array<string>"), F.array().cast("array<string>"))
    images = F.filter(images, lambda u: u.isNotNull())
    rows = places.join(aliases(names), "place_id", "left")
    known = F.coalesce("__names", F.array().cast("array<struct<name:string,low:string>>"))
    return rows.select(
        c("place_id").cast("string").alias("place_id"), c("business_id").cast("string").alias("business_id"), F.coalesce("canonical_name", F.lit("")).alias("name"),
        F.transform(F.filter(known, lambda a: ~F.array_contains(own, a["low"])), lambda a: a["name"]).alias("aliases"), F.coalesce("normalized_name", F.lit("")).alias("normalized_name"),
        F.when(F.coalesce("canonical_category", F.lit("")) != "", F.array("canonical_category")).otherwise(F.array().cast("array<string>")).alias("category_ids"), "lat", "lon", c("admin_unit_id").cast("string").alias("admin_unit_id"),
        F.when(c("status").isin(*STATUSES), c("status")).otherwise("unknown").alias("status"), F.coalesce(c("confidence").cast("double"), F.lit(0.0)).alias("confidence"), scores.projection_freshness(c("last_seen"), now).alias("freshness_score"), "address",
        F.when(F.coalesce("phone", F.lit("")) != "", F.array("phone")).otherwise(F.array().cast("array<string>")).alias("phone"), "website", "website_domain", payload.unwrapped(c("opening_hours")).alias("opening_hours"), c("rating").cast("double").alias("rating"), c("review_count").cast("int").alias("review_count"), "price_level",
        F.coalesce(F.nullif("primary_image_url", F.lit("")), F.get(images, F.lit(0))).alias("primary_image_url"), images.alias("images"), F.coalesce(c("source_count").cast("int"), F.lit(0)).alias("source_count"), c("last_seen").alias("last_verified_at"), "updated_at",
    )


def with_location(docs: DataFrame) -> DataFrame:
    """The document of an index: a point, null without both coordinates."""
    return docs.withColumn("location", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon")))


def canonical_fields(votes: DataFrame) -> DataFrame:
    """Chosen votes (place_id, field, value): one row a place, fields by their columns; location is lat,lon and
    images a JSON list whose first is the primary image."""
    names = {"name": "canonical_name", "address": "address", "phone": "phone", "website": "website", "category": "canonical_category", "hours": "opening_hours", "status": "status", "rating": "rating", "review_count": "review_count", "price_level": "price_level", "images": "images"}
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    rows = votes.groupBy("place_id").agg(*[of(f).alias(col) for f, col in names.items()], of("location").alias("__at"))
    at = F.split("__at", ",")
    return rows.withColumns({"lat": F.get(at, F.lit(0)).try_cast("double"), "lon": F.get(at, F.lit(1)).try_cast("double"), "primary_image_url": F.get_json_object("images", "$[0]")}).drop("__at")


def contributor_view(records: DataFrame, category: Column) -> DataFrame:
    """Staged records as normalised rows with a map of the fields that they have."""
    c = F.col
    fields = {"name": c("raw_name"), "address": c("raw_address"), "phone": text.norm_phone(c("raw_phone")), "category": category, "status": text.norm_status(c("raw_status"))}
    full = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull() & (v != ""))
    return records.select("record_id", "provider", text.norm_name(c("raw_name")).alias("norm_name"), text.norm_address(c("raw_address")).alias("norm_address"), text.norm_phone(c("raw_phone")).alias("phone"), category.alias("category"), "lat", "lon", full.alias("fields"))


def sources_of(links: DataFrame, records: DataFrame) -> DataFrame:
    """Every link with its record's provider, id and name."""
    return links.join(records, "record_id").select("place_id", "record_id", "provider", "external_id", "raw_name")


def details(docs: DataFrame, sources: DataFrame, provenance: DataFrame) -> DataFrame:
    """Documents with their lineage (source structs by record) and provenance (by field, heaviest vote first)."""
    s = sources.groupBy(F.col("place_id").cast("string").alias("place_id")).agg(F.array_sort(F.collect_list(F.struct("record_id", "provider", "external_id"))).alias("sources"))
    p = provenance.groupBy(F.col("place_id").cast("string").alias("place_id")).agg(F.array_sort(F.collect_list(F.struct("field", (-F.col("weight")).alias("order"), "provider", "value", "chosen"))).alias("provenance"))
    return docs.join(s, "place_id", "left").join(p, "place_id", "left")


def cards(found: DataFrame) -> DataFrame:
    """ranked documents as response rows: first category and phone, rounded distance, a map link."""
    link = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.col("lat"), F.lit(","), F.col("lon")))
    return found.select(
        F.coalesce(F.col("place_id").try_cast("long").cast("string"), "place_id").alias("place_id"), "name", F.get("category_ids", F.lit(0)).alias("canonical_category"), "address", F.get("phone", F.lit(0)).alias("phone"), "website", "lat", "lon", "status", "confidence", "source_count", "freshness_score",
        F.round("distance_m", 1).alias("distance_m"), "rating", "review_count", "open_now", link.alias("map_url"),
    )


def stable(cards_: DataFrame) -> DataFrame:
    """without what changes from call to call."""
    return cards_.drop(*VOLATILE)


def legacy_matches(places: DataFrame, q: str, category: str | None = None, admin_unit_id: int | None = None) -> DataFrame:
    """places not permanently closed whose folded name has every word of two characters or more of q."""
    rows = places.where("status <> 'permanently_closed'")
    for word in q.lower().split():
        if len(word) >= 2:
            rows = rows.where(text.fold(F.col("name")).contains(word))
    if category:
        rows = rows.where(F.col("category") == category)
    return rows if admin_unit_id is None else rows.where(F.col("admin_unit_id") == admin_unit_id)
