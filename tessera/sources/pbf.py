"""OpenStreetMap PBF extracts as rows.

Files are read as binary rows by Spark's own reader, so any store that Spark reaches will do; a file is
decoded by one task, blob by blob. Cut a planet file into extracts of at most 2 GB before.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import lifecycle_status, poi_category

DDL = "kind string, id long, tags map<string,string>, lat double, lon double, refs array<long>"
_SCHEMA = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64()))])


def varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers as they are, byte strings as slices; fixed ones as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def signed(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def running(values: list[int]) -> list[int]:
    """Sums of zigzag differences."""
    total, out = 0, []
    for v in values:
        total += signed(v)
        out.append(total)
    return out


def blobs(data: bytes) -> Iterator[bytes]:
    """The contents of the data blobs of a file; a cut-off end is left out."""
    at = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return
        header = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        body = data[at : at + header[3]]
        at += header[3]
        if header[1] != b"OSMData" or len(body) < header[3]:
            continue
        blob = dict(fields(body))
        yield blob[1] if 1 in blob else zlib.decompress(blob[3]) if 3 in blob else lzma.decompress(blob[4])


def elements_of(block: bytes) -> Iterator[tuple]:
    """Rows (kind, id, tags, lat, lon, refs) of a block; a relation's refs are its members' ids."""
    names, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            names = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v
    place = lambda x, zero: 1e-9 * (zero + grain * x)
    for group in groups:
        for n, v in fields(group):
            f = dict(fields(v))
            tags = [(names[k], names[x]) for k, x in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)] if n != 2 else []
            if n == 1:
                yield "node", signed(f[1]), tags, place(signed(f[8]), lat0), place(signed(f[9]), lon0), None
            elif n == 2:
                ids, lats, lons = (running(packed(f.get(k, b""))) for k in (1, 8, 9))
                mixed = iter(packed(f.get(10, b"")))
                for i, y, x in zip(ids, lats, lons, strict=True):
                    tags = []
                    while k := next(mixed, 0):
                        tags.append((names[k], names[next(mixed)]))
                    yield "node", i, tags, place(y, lat0), place(x, lon0), None
            elif n in (3, 4):
                yield ("way" if n == 3 else "relation"), f[1], tags, None, None, running(packed(f.get(8 if n == 3 else 9, b"")))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Every node, way and relation of the files at path."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for block in blobs(data):
                    rows = list(elements_of(block))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, DDL)


def points_of_interest(rows: DataFrame) -> DataFrame:
    """Tagged elements with a category and a position: a node's own, a way's mean of its
    nodes, a relation's mean of its node members and of the ways it holds. Only nodes that something refers to
    take part in the joins."""
    wanted = rows.withColumn("category", poi_category(F.col("tags"))).withColumn("status", lifecycle_status(F.col("tags"))).where("category is not null or status is not null")
    nodes = rows.where("kind = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    ways = rows.where("kind = 'way'").select(F.col("id").alias("way"), F.explode(F.array_distinct("refs")).alias("node"))
    shaped = wanted.where("kind <> 'node'").select("kind", "id", F.explode(F.array_distinct("refs")).alias("ref"))
    direct = shaped.select("kind", "id", F.col("ref").alias("node"))
    through = shaped.where("kind = 'relation'").join(ways, F.col("ref") == F.col("way")).select("kind", "id", "node")
    centres = direct.union(through).distinct().join(nodes, "node").groupBy("kind", "id").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    out = wanted.join(centres, ["kind", "id"], "left")
    return out.select(F.concat_ws("/", "kind", "id").alias("external_id"), F.try_element_at("tags", F.lit("name")).alias("raw_name"), "category", "status", F.coalesce("lat", "c_lat").alias("lat"), F.coalesce("lon", "c_lon").alias("lon"))
