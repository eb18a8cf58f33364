"""Sharding by sampled splitters, law `bytes`."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .runtime import text_of, written

SHARDS = 40
RANGES_PER_SHARD = 32
SAMPLE_PER_RANGE = 16
CELL_ROWS = 4096
ROW_BYTES = 16
SEED = 97
EVEN = 1.005


def _splitters(keys: DataFrame, total: int, ranges: int, seed: int) -> np.ndarray:
    """Quantiles of the key by size, from a sample that takes a row with probability size x m / total
    (at most 1); about m = ranges x SAMPLE_PER_RANGE rows reach the driver, at any input size."""
    m = ranges * SAMPLE_PER_RANGE
    chance = F.col("size") * F.lit(m / max(total, 1))
    coin = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = keys.where(coin < chance).select("key", F.greatest("size", F.lit(total / m)).alias("w")).toPandas().sort_values("key")
    if not len(rows):
        return np.zeros(0, np.int64)
    cum = rows["w"].cumsum().to_numpy()
    at = np.searchsorted(cum, cum[-1] * np.arange(1, ranges) / ranges)
    return np.unique(rows["key"].to_numpy()[at])


def _range_of(splitters: np.ndarray):
    @F.pandas_udf(T.IntegerType())
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), "left").astype(np.int32))

    return find


def _cuts(sizes: dict, unit: float) -> dict:
    return {k: int(np.ceil(v / unit)) for k, v in sizes.items() if v > unit}


def _lookup(cuts: dict, key, default: int = 1) -> "F.Column":
    """How many parts a range or text has; cuts holds only overfull ones, of which there are at most
    total / unit, a number that doesn't grow with the data."""
    if not cuts:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def _placed(sizes: dict, shards: int) -> tuple[list[tuple[str, int]], float]:
    """Cells to shards, largest first, each to the lightest shard; and the heaviest shard's size."""
    load = [(0, s) for s in range(shards)]
    chosen = []
    for cell, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        weight, shard = heapq.heappop(load)
        chosen.append((cell, shard))
        heapq.heappush(load, (weight + n, shard))
    return chosen, max(weight for weight, _ in load)


def _text_parts(texts: dict, others: dict, shards: int, unit: float) -> dict:
    """Into how many parts each large text goes: none if one shard has room for it and the shards still come out even,
    to EVEN; else into parts of half a shard, a quarter and so on, down to a range's size."""
    mean = (sum(texts.values()) + sum(others.values())) / shards
    size = mean
    while True:
        parts = _cuts(texts, size)
        cells = others | {(k, i): v / parts.get(k, 1) for k, v in texts.items() for i in range(parts.get(k, 1))}
        if size <= 2 * unit or _placed(cells, shards)[1] <= EVEN * mean:
            return parts
        size /= 2


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot,
    grown_shard (null under this law).

    Records are ordered by a hash of their text, so equal texts lie together. Splitters from a
    size-weighted sample cut the order into shards x RANGES_PER_SHARD ranges; ranges are then
    measured over all rows and overfull ones are subdivided by another hash of the text. A text that alone
    fills over a range is a cell of its own, cut by a hash of doc_id only if it exceeds a shard or the shards
    would not come out even. Cells go to shards largest first, each to the lightest shard, so equal texts
    share a shard but for those. Texts count as equal by a 64-bit hash: a clash puts two together, no more.

    Slots count from 0 in each shard without gaps: rows fall into cells of about CELL_ROWS by a hash
    of doc_id, are numbered in the cell, and cells are offset by the counts before them.
    Null text: size 16. Null doc_id and repeated rows are sharded like others. Other columns are
    ignored; an empty table gives none.
    """
    text = text_of(docs)
    keys = docs.select(
        docs.doc_id.cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text, F.lit(seed)).alias("key"),
    )
    keys = written(keys, "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    unit = total / (shards * RANGES_PER_SHARD) or 1
    splitters = _splitters(keys, total, shards * RANGES_PER_SHARD, seed)
    ranged = written(keys.withColumn("range", _range_of(splitters)("key")), "ranged")

    sizes = {r[0]: r[1] for r in ranged.groupBy("range").agg(F.sum("size")).toLocalIterator()}
    full = _cuts(sizes, 2 * unit)
    large = ranged.where(F.col("range").isin(*full)) if full else ranged.where("false")
    texts = {r[0]: r[1] for r in large.groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") > unit).toLocalIterator()}  # shards x ranges at most
    alone = F.col("key").isin(*texts) if texts else F.lit(False)
    part = F.pmod(F.xxhash64("key", F.lit(seed + 1)), _lookup(full, F.col("range"))).cast("int")
    parted = ranged.withColumn("cell_key", F.when(alone, F.concat_ws(":", F.lit("t"), "key")).otherwise(F.concat_ws(":", "range", part)))
    sizes = {r[0]: r[1] for r in parted.groupBy("cell_key").agg(F.sum("size")).toLocalIterator()}
    cuts = _text_parts(texts, {k: v for k, v in sizes.items() if not k.startswith("t")}, shards, unit)
    if cuts:
        row_part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), _lookup(cuts, F.col("key"))).cast("int")
        parted = parted.withColumn("cell_key", F.when(F.col("key").isin(*cuts), F.concat_ws(":", "cell_key", row_part)).otherwise(F.col("cell_key")))
        sizes = {r[0]: r[1] for r in parted.groupBy("cell_key").agg(F.sum("size")).toLocalIterator()}
    chosen, _ = _placed(sizes, shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(chosen, "cell_key string, shard int")  # bounded by shards x ranges x 2
    placed = parted.join(F.broadcast(table), "cell_key").select("doc_id", "size", "text_crc32", "key", "shard")

    cells = max(1, -(-rows // (shards * CELL_ROWS)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed + 3)), F.lit(cells)))
    within = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key", "size")) - 1)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
