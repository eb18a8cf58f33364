"""Place search over a serving table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from . import covers

#: Weight of each component, score of each status, related categories. Fixed values.
WEIGHTS = {"text": 0.30, "distance": 0.20, "category": 0.08, "confidence": 0.08, "freshness": 0.07, "sources": 0.06, "status": 0.06, "rating_quality": 0.06, "popularity": 0.04, "open_now_boost": 0.05}
STATUS = {"open": 1.0, "unknown": 0.6, "temporarily_closed": 0.25, "permanently_closed": 0.0}
RELATED = {
    "food": ("retail",), "retail": ("food",), "lodging": ("tourism",), "tourism": ("lodging", "culture"), "culture": ("tourism",),
    "finance": ("services",), "services": ("finance",), "office": ("industrial",), "industrial": ("office",),
}
SOURCES_ENOUGH = 3


def weights_of(raw: str | None) -> dict[str, float]:
    """WEIGHTS with the known, non-negative numbers of a JSON object put over them; else WEIGHTS."""
    import json

    try:
        given = json.loads(raw or "")
    except ValueError:
        given = None
    given = given if isinstance(given, dict) else {}
    return WEIGHTS | {k: float(v) for k, v in given.items() if k in WEIGHTS and isinstance(v, (int, float)) and v >= 0}


@dataclass(frozen=True)
class Spec:
    """what a local query asks."""

    q: str = ""
    lat: float | None = None
    lon: float | None = None
    radius_m: float = 2000.0
    category: str | None = None
    admin_unit_id: int | None = None
    statuses: tuple[str, ...] = ("open", "unknown", "temporarily_closed")
    bbox: tuple[float, float, float, float] | None = None
    limit: int = 20
    sort: str | None = None
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self):
        object.__setattr__(self, "radius_m", min(max(self.radius_m, 1.0), 50_000.0))
        object.__setattr__(self, "limit", min(max(self.limit, 1), 100))


def parse_bbox(raw: str | None) -> tuple[float, float, float, float] | None:
    """west,south,east,north; malformed or inverted gives None."""
    try:
        w, s, e, n = (float(x) for x in (raw or "").split(","))
    except ValueError:
        return None
    return (w, s, e, n) if w < e and s < n else None


def candidates(places: DataFrame, spec: Spec) -> DataFrame:
    """Filters that reach the scan (status, category, unit, box around the radius), then the distance."""
    rows = places.where(F.col("status").isin(*spec.statuses))
    if spec.category:
        rows = rows.where(F.col("category") == spec.category)
    if spec.admin_unit_id is not None:
        rows = rows.where(F.col("admin_unit_id") == spec.admin_unit_id)
    if spec.bbox:
        w, s, e, n = spec.bbox
        rows = rows.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    if spec.lat is None:
        return rows.withColumn("distance_m", F.lit(None).cast("double"))
    dy = spec.radius_m / 111_000 * 1.01
    import math

    dx = dy / max(math.cos(math.radians(spec.lat)), 0.05)
    rows = rows.where(F.col("lat").between(spec.lat - dy, spec.lat + dy) & F.col("lon").between(spec.lon - dx, spec.lon + dx))
    rows = rows.withColumn("distance_m", geo.haversine_m(F.lit(spec.lat), F.lit(spec.lon), F.col("lat"), F.col("lon")))
    return rows.where(F.col("distance_m") <= spec.radius_m)


def category_score(asked: str | None, found: Column) -> Column:
    """.5 where none is asked, .3 for a place without one, 1 equal, .6 related, else 0."""
    if not asked:
        return F.lit(0.5)
    near = [c for c, others in RELATED.items() if asked in others]
    return F.when(found.isNull() | (found == ""), 0.3).when(found == asked, 1.0).when(found.isin(*near), 0.6).otherwise(0.0)


def ranked(rows: DataFrame, spec: Spec) -> DataFrame:
    """Rows with relevance (null or not positive: no text match), distance_m and the place's fields. Adds
    score and rating_quality; the best spec.limit. Text counts relative to the best relevance."""
    best = rows.agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("__best"))  # one row
    rows = rows.join(F.broadcast(best))
    parts = {
        "text": F.when(F.col("relevance") > 0, F.least(F.lit(1.0), F.col("relevance") / F.col("__best"))).otherwise(0.0),
        "distance": geo.distance_score(F.col("distance_m")),
        "category": category_score(spec.category, F.col("category")),
        "confidence": scores.clamp(F.coalesce(F.col("confidence"), F.lit(0.0))),
        "freshness": scores.clamp(F.coalesce(F.col("freshness"), F.lit(0.0))),
        "sources": scores.clamp(F.coalesce(F.col("source_count"), F.lit(0)) / SOURCES_ENOUGH),
        "status": scores.lookup(STATUS, F.coalesce(F.col("status"), F.lit("unknown")), STATUS["unknown"]),
        "rating_quality": scores.bayesian_rating(F.col("rating"), F.col("review_count")),
        "popularity": scores.popularity(F.col("review_count")),
        "open_now_boost": F.when(F.col("open_now"), 1.0).when(~F.col("open_now"), 0.0).otherwise(0.5) if "open_now" in rows.columns else F.lit(0.5),
    }
    score: Column = sum((spec.weights[k] * v for k, v in parts.items()), F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 9)).withColumn("rating_quality", parts["rating_quality"]).drop("__best")
    tail = [F.asc_nulls_last("distance_m"), F.col("place_id")]
    order = {"distance": [F.asc_nulls_last("distance_m"), F.desc("score"), F.col("place_id")], "rating": [F.desc("rating_quality"), F.desc("score"), *tail], "popularity": [F.desc(F.coalesce("review_count", F.lit(0))), F.desc("score"), *tail]}
    return rows.orderBy(*order.get(spec.sort or "", [F.desc("score"), *tail])).limit(spec.limit)


def asked_tokens(q: str) -> Column:
    """The words of a query, folded as names are: "Phở  Thìn" asks for pho and thin."""
    return text.name_tokens(text.fold_diacritics(F.lit(q)))


def place_search(places: DataFrame, spec: Spec) -> DataFrame:
    """Places (place_id, name, category, lat, lon, admin_unit_id, status, confidence, freshness, rating,
    review_count, source_count; open_now if known): the ranked best. Every asked word, folded, has to stand in the folded name, in
    any order; a name that is the query itself is worth twice as much. Misspelt words are found by names.NameIndex, whose matches may be given as `relevance`."""
    rows = candidates(places, spec)
    asked = asked_tokens(spec.q)
    if spec.q.strip() and "relevance" not in places.columns:
        folded = text.fold_diacritics(F.coalesce("name", F.lit("")))
        rows = rows.where(F.forall(asked, lambda t: F.contains(folded, t))).withColumn("relevance", F.when(folded == text.fold_diacritics(F.lit(spec.q)), 1.0).otherwise(0.5))
    elif "relevance" not in places.columns:
        rows = rows.withColumn("relevance", F.lit(0.0))
    return ranked(rows, spec)


def open_filtered(rows: DataFrame, spec: Spec, open_now: bool) -> DataFrame:
    """the best spec.limit of those that are open (or closed) now. The filter comes before the cut, so that it never starves the limit; a place
    whose hours aren't known is neither."""
    return ranked(rows.where(F.col("open_now") == open_now), spec)


def autocomplete(places: DataFrame, prefix: str, limit: int = 10, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """Names that have all asked words but the last, and a word that begins with the last, all folded; nearness halves every
    2 km squared-wise. Fewer than two characters give none."""
    if len(prefix.strip()) < 2:
        return places.limit(0).select("place_id", "name", F.lit(0.0).alias("score"))
    asked, names = asked_tokens(prefix), text.name_tokens(text.fold_diacritics(F.coalesce("name", F.lit(""))))
    whole, last = F.slice(asked, 1, F.greatest(F.size(asked) - 1, F.lit(0))), F.element_at(asked, -1)
    begins = (F.size(F.array_except(whole, names)) == 0) & F.exists(names, lambda t: F.startswith(t, last))
    near = F.lit(1.0) if lat is None else F.coalesce(F.exp(F.log(F.lit(0.5)) * F.pow(geo.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) / 2000, 2)), F.lit(0.0))
    return places.where(begins).select("place_id", "name", F.round(near, 9).alias("score")).orderBy(F.desc("score"), "place_id").limit(limit)


def open_at(hours: Column, minute: Column) -> Column:
    """Hours: array of structs (opens, closes) in minutes; null: unknown, empty: closed; a range over midnight wraps."""
    inside = F.exists(hours, lambda r: F.when(r.closes > r.opens, (minute >= r.opens) & (minute < r.closes)).otherwise((minute >= r.opens) | (minute < r.closes)))
    return F.when(hours.isNull(), F.lit(None).cast("boolean")).otherwise(inside)


def minutes(clock: Column) -> Column:
    """HH:MM as minutes; 24:00 is 1440; malformed gives null."""
    ok = clock.rlike(r"^(?:[01]?[0-9]|2[0-4]):[0-5][0-9]$")
    return F.when(ok, F.split(clock, ":")[0].cast("int") * 60 + F.split(clock, ":")[1].cast("int"))


def geo_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Left (id, lat, lon) and right (place_id, lat, lon) rows within radius_m of each other, with distance_m: an
    equality join on grid cells and their neighbours.

    Bands of latitude have one height; each is cut into as many cells round the globe as its narrower edge allows, so a cell is as wide as high
    anywhere. A left row meets the cells of three bands that its circle may touch, over the 180th meridian as well, and all of a band at the pole.
    Distances are found once a spot of the left side, however many rows stand there.
    """
    size = min(radius_m / geo.METRES_A_DEGREE * 1.01, 90.0)
    located, b = (df.where("lat is not null and lon is not null") for df in (left, right))
    a = located.select("lat", "lon").distinct().withColumn("cy", F.explode(geo.neighbours(geo.cell(F.col("lat"), size)))).withColumn("cx", F.explode(geo.cells_within(F.col("lat"), F.col("lon"), F.col("cy"), size)))
    b = b.withColumnsRenamed({"lat": "plat", "lon": "plon"}).withColumn("cy", geo.cell(F.col("plat"), size)).withColumn("cx", geo.cell_in_band(F.col("plon"), F.col("cy"), size))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    near = a.join(b, ["cy", "cx"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("cy", "cx")
    return located.join(near, ["lat", "lon"]).select(*left.columns, *[c for c in near.columns if c not in ("lat", "lon")])


def in_polygons(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points (lon, lat) in shapes (rings or ring, and other columns that return): an equality join on the cells of their covers. Points in an
    inner cell need no more; in a cell on the border rays are cast over the edges beside it. A point stands in one cell of a level and a cover's
    cells are apart, so a pair comes once. Rows without coordinates are in no shape."""
    cells = covers.cover(shapes)
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # covers.LEVELS numbers at most
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), geo.cell(F.col("lon"), covers.size_of(k)).alias("cx"), geo.cell(F.col("lat"), covers.size_of(k)).alias("cy")) for k in levels])) if levels else F.explode(F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))
    p = points.where("lon is not null and lat is not null").select("*", at.alias("__at")).select("*", "__at.*").drop("__at")
    lon, lat = F.col("lon"), F.col("lat")
    crossed = F.filter("edges", lambda e: ((e.ay > lat) != (e.by > lat)) & (lon < (e.bx - e.ax) * (lat - e.ay) / (e.by - e.ay) + e.ax))
    return p.join(cells, ["level", "cx", "cy"]).where(F.col("inner") | (F.size(crossed) % 2 == 1)).drop("level", "cx", "cy", "inner", "edges")


#: Days by their names. Fixed values.
DAYS = {"thứ hai": "monday", "thứ ba": "tuesday", "thứ tư": "wednesday", "thứ năm": "thursday", "thứ sáu": "friday", "thứ bảy": "saturday", "chủ nhật": "sunday"}


def day_ranges(hours: Column, day: str) -> Column:
    """Of hours (JSON: day to a list of ranges) the ranges of a day as structs (opens, closes) in minutes: null without the
    day, empty if it is closed; what isn't a range is left out, a day and night is 0 to 1440."""
    tidy = lambda s: text.squeezed(s)
    days = F.from_json(hours, "map<string,array<string>>")
    names = [day.lower(), *[k for k, v in DAYS.items() if v == day.lower()]]
    mine = F.map_values(F.map_filter(days, lambda k, v: F.lower(tidy(k)).isin(*names)))
    items = F.filter(F.get(mine, F.lit(0)), lambda i: ~F.lower(tidy(i)).isin("đóng cửa", "closed"))

    def span(i: Column) -> Column:
        parts = F.split(tidy(i), "[–—-]")
        whole = F.lower(i).rlike(r"24\s*(?:hours?|hrs?|h)(?:$|[^\p{L}\p{N}_])|24/7|mở cửa cả ngày")
        a, b = minutes(F.trim(F.get(parts, F.lit(0)))), minutes(F.trim(F.get(parts, F.lit(1))))
        pair = F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("opens"), b.alias("closes")))
        return F.when(whole, F.struct(F.lit(0).alias("opens"), F.lit(1440).alias("closes"))).otherwise(pair)

    return F.when(F.size(mine) > 0, F.filter(F.transform(items, span), lambda r: r.isNotNull()))
