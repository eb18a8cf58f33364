"""A business described in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scores, understanding

#: What shows each field. Fixed values.
ADDRESS = r"(?i)(?:địa\s*chỉ|address|located\s*at|địa\s*điểm|chỗ|nằm\s*tại)\s*[:\-]?\s*([^\n]+)"
PHONE = r"\+84\s?[0-9]{8,10}|\+84\s?\(?[0-9]{1,3}\)?\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}|0[0-9]{2}\s?[0-9]{3,4}\s?[0-9]{3,4}|0[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
WEBSITE = r"(?i)https?://[^\s\"\)\]<>]+"
RATING = r"([0-9]+(?:\.[0-9]+)?)\s*/\s*5(?:$|[^\p{L}\p{N}_])"
HOURS = r"([0-9]{1,2}:[0-9]{2})\s*[-–]\s*([0-9]{1,2}:[0-9]{2})"
COORDS = r"(-?[0-9]{1,3}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)"
NO_NAME = ("địa chỉ", "address", "phone", "tel", "email")


def _first(x: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, pattern, group)), F.lit(""))


def business(content: Column, query: Column, source_url: Column) -> Column:
    """A struct of name, category, address, phone, hours, rating, website, lat, lon and description; null without a name
    and any other sign of a business. The name is the first of five lines that fits, a quoted one, else the query."""
    body = F.trim(content)
    lines = F.transform(F.slice(F.split(body, r"\r?\n"), 1, 5), lambda x: F.regexp_replace(F.trim(x), r"^[#*\-=–]+|[#*\-=–]+$", ""))
    fits = F.filter(lines, lambda x: (F.length(x) >= 3) & (F.length(x) <= 120) & ~sum((F.lower(x).startswith(p).cast("int") for p in NO_NAME), F.lit(0)).cast("boolean"))
    name = F.coalesce(F.get(fits, F.lit(0)), _first(body, r"[\"']([^\"']{3,80})[\"']", 1), F.nullif(F.trim(query), F.lit("")))
    address = F.coalesce(F.trim(F.regexp_extract(F.trim(F.regexp_extract(body, understanding.java(ADDRESS), 1)), r"^((?:[^;.]|\.(?!\s))*\.?)", 1)), F.lit(""))
    site = F.get(F.filter(F.regexp_extract_all(body, F.lit(WEBSITE), F.lit(0)), lambda u: ~((source_url != "") & (u == source_url))), F.lit(0))
    rating = scores.clamp(_first(body, RATING, 1).cast("double"), 0.0, 5.0)
    hours = F.when(F.regexp_extract(body, HOURS, 1) != "", F.concat_ws(" - ", F.regexp_extract(body, HOURS, 1), F.regexp_extract(body, HOURS, 2)))
    pairs = F.transform(F.regexp_extract_all(body, F.lit(COORDS), F.lit(0)), lambda p: F.struct(F.trim(F.split(p, ",")[0]).cast("double").alias("lat"), F.trim(F.split(p, ",")[1]).cast("double").alias("lon")))
    place = F.get(F.filter(pairs, lambda p: p.lat.between(-90, 90) & p.lon.between(-180, 180)), F.lit(0))
    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 20)
    description = F.trim(F.substring(F.coalesce(F.get(paragraphs, F.lit(0)), body), 1, 500))
    phone, email = _first(body, PHONE), _first(body, EMAIL)
    found = F.struct(
        F.coalesce(name, F.lit("Unknown")).alias("name"), understanding.taxonomy(F.concat_ws(" ", query, F.substring(body, 1, 500))).alias("category"), address.alias("address"), phone.alias("phone"), hours.alias("hours"), rating.alias("rating"),
        site.alias("website"), place.lat.alias("lat"), place.lon.alias("lon"), description.alias("description"),
    )
    known = name.isNotNull() | phone.isNotNull() | site.isNotNull() | email.isNotNull() | (address != "")
    return F.when((body != "") & known, found)
