"""The nearest places of each record within groups of any size: tiles, bounds by tile, best lists in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows that a tile has on average, and at most: a fuller one is cut by a hash.
TILE_ROWS, MOST_ROWS = 500, 1000
_PAIR = pa.schema([("s_id", pa.int64()), ("p_id", pa.int64())])


def _tiled(rows: DataFrame, grid: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """rows (ident, lat, lon, keys) in blocks: keys, block, ids, and x, y, z on the unit sphere, MOST_ROWS or about so many."""
    spot = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col(f"{c}0")) / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0)) * F.col("g")).cast("long"), F.lit(0)), F.col("g") - 1)
    lat, lon = F.radians("lat"), F.radians("lon")
    at = rows.join(grid, keys).select(*keys, F.col(ident).alias("id"), (F.coalesce(spot("lat"), F.lit(0)) * F.col("g") + F.coalesce(spot("lon"), F.lit(0))).alias("tile"), (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    at = written(at, "tiled")
    parts = written(at.groupBy(*keys, "tile").agg(F.ceil(F.count("*") / MOST_ROWS).alias("parts")), "tiles")
    cut = at.join(parts, [*keys, "tile"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = cut.groupBy(*keys, "tile", "part").agg(F.collect_list(F.struct("id", "x", "y", "z")).alias("r"))  # about MOST_ROWS rows each
    return written(packed.select(*keys, F.concat_ws(":", "tile", "part").alias("block"), F.col("r.id").alias("ids"), F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.z").alias("z")), "blocks")


def _box() -> Column:
    return F.array(*[f(c) for c in ("x", "y", "z") for f in (F.array_min, F.array_max)])


def reachable(own: np.ndarray, boxes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Which boxes (x0, x1, y0, y1, z0, z1) may hold one of the `most` nearest of any point in `own`: those not farther at least than
    the distance within which, at most, as many points lie."""
    lo, hi = boxes[:, 0::2], boxes[:, 1::2]
    gap = np.maximum(0, np.maximum(lo - own[1::2], own[0::2] - hi))
    far = np.maximum(np.abs(hi - own[0::2]), np.abs(own[1::2] - lo))
    least, largest = np.sqrt((gap**2).sum(1)), np.sqrt((far**2).sum(1))
    order = np.argsort(largest)
    enough = np.searchsorted(np.cumsum(counts[order]), most)
    return np.flatnonzero(least <= largest[order[min(enough, len(order) - 1)]] * (1 + 1e-9) + 1e-12) if enough < len(order) else np.arange(len(order))


def _best_lists(most: int):
    """Rows sorted by the records' block: records and one block of places each. The best of each record over all its blocks, and those that tie with the last."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, ids, spots, dist, near = None, None, None, None, None

        def give():
            rows, cols = np.nonzero(np.isfinite(dist))
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(near[rows, cols])], schema=_PAIR)

        for batch in batches:
            part = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731  one row's list, not the batch's as Python objects
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block != now:
                    if now is not None:
                        yield give()
                    now, ids = block, part("s_ids", i).astype(np.int64)
                    spots = np.stack([part("sx", i), part("sy", i), part("sz", i)], 1).astype(float)
                    dist, near = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
                other, them = part("ids", i).astype(np.int64), np.stack([part("x", i), part("y", i), part("z", i)], 1).astype(float)
                d = np.sqrt(np.maximum(0, ((spots[:, None, :] - them[None, :, :]) ** 2).sum(2)))
                dist, near = np.concatenate([dist, d], 1), np.concatenate([near, np.broadcast_to(other, d.shape)], 1)
                if dist.shape[1] > most:
                    edge = np.partition(dist, most - 1, axis=1)[:, most - 1 : most] * (1 + 1e-9) + 1e-12
                    dist = np.where(dist <= edge, dist, np.inf)
                    width = int(np.isfinite(dist).sum(1).max())
                    order = np.argsort(dist, axis=1, kind="stable")[:, :width]
                    dist, near = np.take_along_axis(dist, order, 1), np.take_along_axis(near, order, 1)
        if now is not None:
            yield give()

    return run


def nearest(s: DataFrame, p: DataFrame, keys: list[str], most: int) -> DataFrame:
    """s (s_id, lat, lon, keys) and p (p_id, lat, lon, keys): s_id, p_id: for each record at least its `most` nearest places of equal keys by (distance, p_id), those
    without coordinates last. A few more that tie may be among them; never a product.

    Places at one spot count by their first `most` ids. Both sides are packed into tiles of their group's box; from the tiles' boxes follows which
    tiles of places a tile of records has to see, and a task sees those one after the other and keeps the best of each record: memory is two tiles and
    the lists. Records or places without coordinates have no distance: for them the first ids count.
    """
    spot = [*keys, "lat", "lon"]
    first = p.withColumn("__n", F.row_number().over(Window.partitionBy(*spot).orderBy("p_id"))).where(F.col("__n") <= most).drop("__n")
    first = written(first, "spots")
    located, lost = first.where("lat is not null and lon is not null"), first.where("lat is null or lon is null")
    count = located.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    grid = written(count.withColumn("g", F.ceil(F.sqrt(F.col("__n") / TILE_ROWS)).cast("long")).drop("__n"), "grids")
    theirs, mine = _tiled(located, grid, keys, "p_id"), _tiled(s.where("lat is not null and lon is not null"), grid, keys, "s_id")
    boxes = theirs.groupBy(*keys).agg(F.collect_list(F.struct("block", F.size("ids").alias("n"), _box().alias("box"))).alias("boxes"))  # a few numbers a tile
    kinds = ", ".join(f"`{k}` {mine.schema[k].dataType.simpleString()}" for k in keys)

    def scheduled(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(len(keys) + 2)[i].as_py()
                found = reachable(np.array(batch.column(len(keys) + 1)[i].as_py()), np.array([r["box"] for r in rows]), np.array([r["n"] for r in rows]), most)
                at = pa.array([i] * len(found))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys) + 1)), pa.array([rows[k]["block"] for k in found], pa.string())], [*keys, "block", "theirs"])

    plan = mine.select(*keys, "block", _box().alias("box")).join(boxes, keys).mapInArrow(scheduled, f"{kinds}, block string, theirs string")
    plan = written(plan, "schedule")
    named = mine.select(*keys, F.col("block"), F.col("ids").alias("s_ids"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    pairs = plan.join(theirs.withColumnRenamed("block", "theirs"), [*keys, "theirs"]).join(named, [*keys, "block"])
    pairs = pairs.select(F.to_json(F.struct(*keys, "block")).alias("block"), "s_ids", "sx", "sy", "sz", "ids", "x", "y", "z")
    near = pairs.repartition("block").sortWithinPartitions("block").mapInArrow(_best_lists(most), "s_id long, p_id long")
    by_id = lambda rows: rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("p_id"))).where(F.col("__n") <= most).select(*keys, "p_id")
    beside = s.select("s_id", *keys).join(by_id(lost), keys).select("s_id", "p_id")
    blind = s.where("lat is null or lon is null").select("s_id", *keys).join(by_id(first), keys).select("s_id", "p_id")
    return near.union(beside).union(blind).distinct()
