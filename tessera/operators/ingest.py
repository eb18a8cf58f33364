"""Ingest and incremental serving: validation, change classes, upserts, deltas, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text, urls
from . import ordered


def reject_reasons(c=F.col) -> Column:
    """columns raw_name, external_id, observed_at, lat, lon, raw_phone, raw_website, parse_error."""
    blank = F.trim(F.coalesce(c("raw_name"), F.lit(""))) == ""
    lat, lon = c("lat"), c("lon")
    outside = ~(lat.between(6, 24) & lon.between(100, 119.5))
    where = F.when(lat.isNull() & lon.isNull(), F.lit(None)).when(lat.isNull() | lon.isNull(), "partial_coordinates").when(~lat.between(-90, 90), "invalid_latitude").when(~lon.between(-180, 180), "invalid_longitude").when(outside, "coords_outside_vietnam")
    checks = [
        F.when(blank, "missing_name"),
        F.when(blank & (F.trim(F.coalesce(c("external_id"), F.lit(""))) == ""), "missing_identity"),
        F.when(c("observed_at").isNull(), "missing_observed_at"),
        where,
        F.when((c("raw_phone") != "") & text.norm_phone(c("raw_phone")).isNull(), "implausible_phone"),
        F.when((c("raw_website") != "") & urls.canonical_website(c("raw_website")).isNull(), "malformed_website"),
    ]
    return F.when(c("parse_error"), F.array(F.lit("parse_error"))).otherwise(F.array_compact(F.array(*checks)))


def validated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reasons)."""
    checked = records.withColumn("reasons", reject_reasons())
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def error_envelope(payload: Column, most: int = 32_768) -> Column:
    """Valid JSON in any case; a long payload becomes its first kilobyte and its size."""
    preview = F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(payload).alias("length"), F.substring(payload, 1, 1024).alias("preview")))
    return F.when(F.length(payload) > most, preview).otherwise(payload)


def change_classes(new: DataFrame, old: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """New rows with change_type new, changed or unchanged."""
    prior = old.select(*key, F.col(digest).alias("__prior"))
    kind = F.when(F.col("__prior").isNull(), "new").when(F.col("__prior") == F.col(digest), "unchanged").otherwise("changed")
    return new.join(prior, key, "left").withColumn("change_type", kind).drop("__prior")


def merged(target: DataFrame, source: DataFrame, key: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert as one full outer join: source values win, except that a null doesn't
    overwrite and keep_old columns stay as they were where there is a target row."""
    s = source.select(*key, *[F.col(c).alias(f"__{c}") for c in source.columns if c not in key])
    joined = target.withColumn("__had", F.lit(True)).join(s, key, "full_outer")
    pick = lambda c: F.coalesce(c, F.col(f"__{c}")) if c in keep_old else F.coalesce(F.col(f"__{c}"), F.col(c))
    return joined.select(*key, *[pick(c).alias(c) if f"__{c}" in s.columns else F.col(c) for c in target.columns if c not in key])


def delta(rows: DataFrame, updated: str, key: str, ts, last) -> DataFrame:
    """Rows after the cursor (ts, last), compared as a pair; both sides of OR reach the scan."""
    u = F.col(updated)
    return rows.where((u > ts) | ((u == ts) & (F.col(key) > last)))


def reconciled(index: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Every id and where it is: both, index or canonical."""
    a, b = index.select(key).distinct().withColumn("a", F.lit(1)), canonical.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull(), "canonical").when(F.col("b").isNull(), "index").otherwise("both").alias("side"))


def frontier(old: DataFrame, found: DataFrame) -> DataFrame:
    """(url, priority, depth, next_crawl, status): the highest priority, least depth and earliest
    crawl; a known url turns pending again only from done or failed."""
    both = old.withColumn("known", F.lit(True)).unionByName(found.withColumn("known", F.lit(False)))
    held = F.max(F.when(F.col("known"), F.col("status")))
    seen = F.count_if(~F.col("known")) > 0
    status = F.when(held.isNull(), "pending").when(held.isin("done", "failed") & seen, "pending").otherwise(held)
    return both.groupBy("url").agg(F.max("priority").alias("priority"), F.min("depth").alias("depth"), F.min("next_crawl").alias("next_crawl"), status.alias("status"))


def due(frontier_rows: DataFrame, now: Column, n: int) -> DataFrame:
    """The n most urgent rows that are due."""
    return frontier_rows.where((F.col("status") == "pending") & (F.col("next_crawl") <= now)).orderBy(F.desc("priority"), "next_crawl", "url").limit(n)


def polite_schedule(requests: DataFrame, gap_s: float = 2.0, bucket_s: float = 3600.0) -> DataFrame:
    """Earliest start of each request of a domain, gap_s apart: max(ts_i, start_{i-1} + gap), in closed
    form as a running maximum of ts - i x gap, over buckets of time: a busy domain is many tasks."""
    rows = ordered.positioned(requests, "domain", ["ts_s", "request_id"], F.floor(F.col("ts_s") / bucket_s))
    rows = ordered.running_max(rows, "domain", F.col("ts_s") - F.col("__pos") * gap_s, "__lag")
    return rows.withColumn("start_s", F.col("__lag") + F.col("__pos") * gap_s).drop("__lag", "__pos", "__bucket")


def recrawl(pages: DataFrame) -> DataFrame:
    """D10, D12."""
    return pages.withColumn("interval_h", scores.recrawl_hours(F.col("change_rate"))).withColumn("backoff_min", scores.backoff_minutes(F.col("failures")))


def page(rows: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows behind a key, in its order; the filter reaches the scan."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)


def last_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order))).alias("r"))
    return newest.select("r.*")


def index_rows(docs: DataFrame, body: str = "text") -> DataFrame:
    """Documents as index rows: content_hash, word_count and the 16-digit short hash."""
    b = F.coalesce(F.col(body), F.lit(""))
    return docs.withColumns({"content_hash": F.sha2(F.encode(b, "UTF-8"), 256), "word_count": F.size(F.filter(F.split(F.trim(b), r"\s+"), lambda w: w != "")), "simhash": text.short_hash(b, 16)})


def new_places(rows: DataFrame, highest: int, parts: int = 256) -> DataFrame:
    """Rows (key, lat, lon and more) as new places: ids behind the highest there is, gapless in the order of a hash of key, and
    a point where both coordinates are. Rows are numbered in `parts` ranges of the hash, offset by their counts."""
    spread = rows.withColumn("__all", F.lit(0)).withColumn("__h", F.pmod(F.xxhash64("key"), F.lit(1 << 30)))
    ids = ordered.positioned(spread, "__all", ["__h", "key"], F.floor(F.col("__h") / ((1 << 30) // parts)))
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    return ids.withColumn("place_id", F.col("__pos") + 1 + highest).withColumn("location", point).drop("__all", "__h", "__pos", "__bucket")
