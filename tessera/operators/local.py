"""Candidates of local discovery: merging, gates, ranks."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, spans, text, understanding

FOODISH = ("restaurant", "cafe", "food", "bar", "store", "convenience")
LANES = ("canonical", "osm_local", "osm_live")
FILLED = ("phone", "hours", "website", "address", "description", "category")
COUNTED = (*FILLED, "name", "lat", "lon", "rating", "price_level", "source_url")
SCHEMA = "query_id long, pos long, name string, category string, address string, phone string, hours string, rating double, price_level string, website string, lat double, lon double, description string, source_url string, origin string"


def completeness() -> Column:
    """How many of COUNTED a candidate has."""
    known = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in COUNTED]
    return sum((k.cast("int") for k in known), F.lit(0))


def _plain(s) -> str:
    return " ".join(spans._fold(s or "").split())


def _alike(a, b) -> float:
    a, b = _plain(a), _plain(b)
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _phone(p) -> str:
    d = re.sub(r"\D+", "", p or "")
    if d.startswith("0084"):
        return "0" + d[4:]
    return "0" + d[2:] if d.startswith("84") and ((p or "").strip().startswith("+") or len(d) == 11) else d


def _site(u) -> str:
    u = (u or "").strip()
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (u if "://" in u else "https://" + u).lower()) if u else None
    return m.group(1).removeprefix("www.") if m else ""


def _metres(a, b) -> float:
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(h))


def same(a: dict, b: dict) -> bool:
    """The same phone; the same site and names alike by .6; names alike by .88 within 100 m; or name (.9) and address (.85)."""
    if _phone(a["phone"]) and _phone(a["phone"]) == _phone(b["phone"]):
        return True
    names = _alike(a["name"], b["name"])
    if _site(a["website"]) and _site(a["website"]) == _site(b["website"]) and names >= 0.60:
        return True
    placed = None not in (a["lat"], a["lon"], b["lat"], b["lon"])
    if names >= 0.88 and placed and _metres(a, b) <= 100.0:
        return True
    return names >= 0.90 and bool(_plain(a["address"]) and _plain(b["address"])) and _alike(a["address"], b["address"]) >= 0.85


def merge_rows(rows: list[dict]) -> list[dict]:
    """In order, each row joins the first that it is the same as. The earlier one keeps its identity unless the
    later one is fuller and brings the coordinates it lacks; empty fields are filled, none is overwritten."""
    full = lambda r: sum(r[c] not in (None, "") for c in COUNTED)
    out: list[dict] = []
    for row in rows:
        at = next((i for i, kept in enumerate(out) if same(kept, row)), None)
        if at is None:
            out.append(row | {"__urls": {row["source_url"]} - {None, ""}, "supporting": 1})
            continue
        kept = out[at]
        lacks = kept["lat"] is None or kept["lon"] is None
        base, other = (row, kept) if full(row) > full(kept) and lacks and None not in (row["lat"], row["lon"]) else (kept, row)
        merged = dict(base)
        for c in FILLED:
            merged[c] = merged[c] if merged[c] not in (None, "") else other[c]
        if merged["lat"] is None and merged["lon"] is None:
            merged["lat"], merged["lon"] = other["lat"], other["lon"]
        urls = kept["__urls"] | ({kept["source_url"], row["source_url"]} - {None, ""})
        out[at] = merged | {"__urls": urls, "supporting": max(1, len(urls)), "pos": kept["pos"]}
    return out


def merged(candidates: DataFrame) -> DataFrame:
    """merge_rows() for each query: SCHEMA's columns, then supporting (distinct addresses that tell of it). A group is the
    candidates of one query, some dozens: the order of merging is its meaning."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = candidates.select(*[F.col(n) if n in candidates.columns else F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in SCHEMA.split(", "))])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos").astype(object)
        frame = frame.where(frame.notna(), None)
        return pd.DataFrame([{k: v for k, v in r.items() if k != "__urls"} for r in merge_rows(frame.to_dict("records"))], columns=[*names, "supporting"])

    return rows.groupBy("query_id").applyInPandas(run, SCHEMA + ", supporting int")


def _family(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ((a == b) | (a.isin(*FOODISH) & b.isin(*FOODISH)))


def has_phrase(body: Column, phrases: list[str]) -> Column:
    """A folded phrase as whole words."""
    padded = F.concat(F.lit(" "), text.squeezed(text.fold(body)), F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(f" {_plain(p)} "), True) for p in phrases], F.lit(False))


def recall_gate(candidates: DataFrame, queries: DataFrame, limit: int, specialty: str | None = None) -> DataFrame:
    """queries (query_id, query): query_id, useful, sufficient (five, or `limit` if that is less). Useful: a name and
    coordinates, and what was asked: the speciality; a category of the query's kind, its own or inferred; or a word of the
    name in the query."""
    c = F.col
    joined = F.concat_ws(" ", "name", "description", "address")
    rows = candidates.join(queries.select("query_id", "query"), "query_id")
    placed = (F.trim(F.coalesce("name", F.lit(""))) != "") & c("lat").isNotNull() & c("lon").isNotNull()
    rows = rows.withColumn("target", understanding.taxonomy(c("query"))).withColumn("inferred", understanding.taxonomy(joined))
    words = F.split(text.squeezed(text.fold(c("query"))), " ")
    named = F.exists(F.split(text.squeezed(text.fold(F.coalesce("name", F.lit("")))), " "), lambda w: (F.length(w) >= 3) & F.array_contains(words, w))
    fits = _family(F.coalesce(F.trim("category"), F.lit("")), c("target")) | _family(c("inferred"), c("target")) | named
    special = has_phrase(joined, [specialty, *spans.SPECIALTIES.get(specialty, "").split("|")]) if specialty else None
    useful = rows.withColumn("ok", placed & (special if specialty else fits)).groupBy("query_id").agg(F.count_if("ok").alias("useful"))
    out = queries.select("query_id").join(useful, "query_id", "left").fillna(0, ["useful"])
    return out.withColumn("sufficient", c("useful") >= min(5, max(0, limit)))


def _loose(a: Column, b: Column) -> Column:
    """Unknown fits, equal fits, and kinds of food fit each other."""
    return F.coalesce(a, F.lit("")).isin("") | (a == b) | (a.isin(*FOODISH) & b.isin(*FOODISH))


def ranked(candidates: DataFrame, query: str, category: str, lat: float | None = None, lon: float | None = None, radius_km: float = 5.0, specialty: str | None = None) -> DataFrame:
    """.25 words of the query in the name, .20 category, .30 speciality, .15 nearness inside the radius (-.20 outside),
    .10 address, phone, website and hours: adds score, best first within query_id."""
    c = F.col
    terms = sorted(set(query.lower().split()))
    low = F.lower(F.coalesce("name", F.lit("")))
    score = sum((low.contains(t).cast("int") for t in terms), F.lit(0)) / max(len(terms), 1) * 0.25 + F.when(_loose(c("category"), F.lit(category)), 0.20).otherwise(0.0)
    if specialty:
        body = text.squeezed(text.fold(F.concat_ws(" ", "name", "description", "address")))
        score = score + F.when(F.coalesce(*[F.when(body.contains(_plain(p)), True) for p in [specialty, *spans.SPECIALTIES.get(specialty, "").split("|")] if p], F.lit(False)), 0.30).otherwise(0.0)
    if lat and lon:
        d = geo.haversine_m(F.lit(lat), F.lit(lon), c("lat"), c("lon")) / (radius_km * 1000)
        score = score + F.when(c("lat").isNull() | c("lon").isNull() | (c("lat") == 0) | (c("lon") == 0), 0.0).when(d <= 1, 0.15 * (1 - d)).otherwise(-0.20)
    filled = sum(((F.coalesce(k, F.lit("")) != "").cast("int") for k in ("address", "phone", "website", "hours")), F.lit(0))
    return candidates.withColumn("score", F.round(score + filled / 4 * 0.10, 9))


def assessed(candidates: DataFrame, category: str, lat: float | None = None, lon: float | None = None, radius_km: float = 5.0) -> DataFrame:
    """for each query how many candidates are useful, of the category, near and complete, and whether they suffice: five
    useful ones, three of them near where a point is asked."""
    c = F.col
    fits = _loose(c("category"), F.lit(category))
    asked = lat is not None and lon is not None
    near = F.coalesce(geo.haversine_m(F.lit(lat), F.lit(lon), c("lat"), c("lon")) <= radius_km * 1000, F.lit(False)) if asked else F.lit(True)
    whole = (F.coalesce("name", F.lit("")) != "") & (F.coalesce("address", F.lit("")) != "") & ((F.coalesce("phone", F.lit("")) != "") | c("lat").isNotNull())
    out = candidates.groupBy("query_id").agg(F.count_if(fits & near).alias("useful"), F.count_if(fits).alias("exact_category"), F.count_if(near).alias("geo_relevant"), F.count_if(whole).alias("complete"), F.count("*").alias("n"))
    enough = (c("useful") >= 5) & ((c("geo_relevant") >= 3) | F.lit(not asked))
    return out.withColumn("sufficient", enough)
