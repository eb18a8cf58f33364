"""Geography scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_A_DEGREE = EARTH_M * math.pi / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M01, M25. Null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_M)


def geo_score(metres: Column) -> Column:
    """1 up to 30 m, linear to 0, -1 from 200 m; .4 without a distance."""
    return F.when(metres.isNull(), 0.4).when(metres <= 30, 1.0).when(metres >= 200, -1.0).otherwise(1 - (metres - 30) / 170)


def geo_bonus(km: Column, reach: float = 50.0) -> Column:
    """M04."""
    return F.greatest(F.lit(0.0), 1 - km / reach)


def distance_score(metres: Column) -> Column:
    """exp(-d/750); .5 without a distance."""
    return F.when(metres.isNull(), 0.5).otherwise(F.exp(-F.greatest(metres, F.lit(0.0)) / 750))


def cell(value: Column, size: float) -> Column:
    """The number of the grid cell of a coordinate."""
    return F.floor(value / size).cast("long")


def neighbours(c: Column) -> Column:
    return F.sequence(c - 1, c + 1)


def cells_of_band(band: Column, size: float) -> Column:
    """Into how many cells a band of latitude `size` degrees high is cut: none is narrower, at its narrower edge, than it is high."""
    edge = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / size)), F.lit(1)).cast("long")


def cell_in_band(lon: Column, band: Column, size: float) -> Column:
    """The number of a longitude's cell in a band; longitudes beyond 180 degrees wrap."""
    n = cells_of_band(band, size)
    return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)


def cells_within(lat: Column, lon: Column, band: Column, size: float) -> Column:
    """The cells of a band that a circle of `size` degrees around a point may touch, each once."""
    n = cells_of_band(band, size)
    near = F.sin(F.radians(F.lit(min(size, 90.0)))) / F.cos(F.radians(lat))
    reach = F.when((F.abs(lat) + size < 90) & (near < 1), F.degrees(F.asin(F.least(near, F.lit(1.0))))).otherwise(180.0)
    edge = lambda x: F.floor((x + 180) / 360 * n).cast("long")
    first, last = edge(lon - reach), edge(lon + reach)
    return F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n)), lambda c: F.pmod(c, n)))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray casting. ring: array of structs (x, y), closed or not."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i == 0, n).otherwise(i)).alias("b")))
    crossed = F.filter(edges, lambda e: ((e.a.y > lat) != (e.b.y > lat)) & (lon < (e.b.x - e.a.x) * (lat - e.a.y) / (e.b.y - e.a.y) + e.a.x))
    return F.size(crossed) % 2 == 1


def box_of(ring: Column) -> Column:
    """Struct of least and greatest x and y."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """By atan2, on a sphere of 6,371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
