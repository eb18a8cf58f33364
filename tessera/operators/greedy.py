"""Greedy clusters in order, settled in rounds: each item joins the earlier founder that it resembles most, or founds a cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Rounds, written

#: Items of a group that are settled one after the other at once; candidate pairs a shingle row up to which all pairs are listed.
BLOCK, PAIRS = 64, 64
#: Shingles of a group that come to one task.
BUCKET = 2_000_000


def containment(a: set, b: set) -> float:
    return len(a & b) / min(len(a), len(b))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def _dealt_batches(buckets: int):
    """grp, bucket, pos, n, sh: the shingles of an item by their bucket."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, sh = _flat(batch.column(3))
                key = row * buckets + (sh ^ (sh >> 17)) % buckets
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
                owner = pa.array(key[order][first] // buckets)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(sh[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(key[order][first] % buckets), batch.column(1).take(owner), batch.column(2).take(owner), lists], ["grp", "bucket", "pos", "n", "sh"])

    return run


def _shared_of(group: pa.Table) -> pa.Table:
    """A row for each item and shingle that another item has as well."""
    lists = group.column("sh").combine_chunks()
    row, sh = _flat(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists)
    _, where, count = np.unique(sh, return_inverse=True, return_counts=True)
    held = count[where] > 1
    rows = group.select(["grp", "pos", "n"]).take(pa.array(row[held]))
    return rows.append_column("s", pa.array(sh[held]))


def shared_rows(items: DataFrame) -> DataFrame:
    """items (grp, pos long, sh array<long> without repeats): grp, pos, n (size of sh), s: the shingles that two items of a group or more have. The others link nothing.
    Shingles are exchanged once, as lists; a task gets a group's, or of a large group a bucket of them."""
    most = items.groupBy("grp").agg(F.sum(F.size("sh")).alias("n")).agg(F.max("n")).first()[0] or 0
    kind = items.schema["grp"].dataType.simpleString()
    lists = items.select("grp", "pos", F.size("sh").alias("n"), F.col("sh").cast("array<long>").alias("sh"))
    dealt = lists.mapInArrow(_dealt_batches(max(1, -(-most // BUCKET))), f"grp {kind}, bucket long, pos long, n int, sh array<long>")
    return dealt.groupBy("grp", "bucket").applyInArrow(_shared_of, f"grp {kind}, pos long, n int, s long")


def _founders_of(least: float):
    """The founders among the first unsettled items of a group, BLOCK at most; whatever came before them has been held against the founders already."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        kept: list[set] = []
        found = []
        for pos, sh in zip(frame["pos"], frame["sh"], strict=True):
            sh = set(sh)
            if not any(round(containment(k, sh), 12) >= least for k in kept):
                kept.append(sh)
                found.append(pos)
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "pos": pd.Series(found, dtype="int64")})

    return run


def _alike(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """grp, a, b, sim of items of a and b (grp, pos, n, s: a row a shingle) with a.pos < b.pos and a containment of `least` or more."""
    left, right = a.select("grp", "s", F.col("pos").alias("a"), F.col("n").alias("na")), b.select("grp", "s", F.col("pos").alias("b"), F.col("n").alias("nb"))
    both = left.join(right, ["grp", "s"]).where("a < b").groupBy("grp", "a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return both.withColumn("sim", F.round(F.col("common") / F.least("na", "nb"), 12)).where(F.col("sim") >= least).select("grp", "a", "b", "sim")


def founders(items: DataFrame, least: float, rows: DataFrame | None = None) -> DataFrame:
    """items (grp, pos long, sh: not empty, no two sets of a group equal): grp, pos of those that no earlier founder resembles: what a fold in order gives.

    While large clusters are left, that is while sharing a shingle would give more than PAIRS candidates a row, the first BLOCK unsettled items of every
    group are folded and what their founders resemble is settled with them: early founders take the large clusters away. The rest lists its
    pairs, and rounds settle each item whose earlier neighbours are settled: a founder if none of them is one. rows: shared_rows() of items, if they are made already.
    """
    spark = items.sparkSession
    rows = written(shared_rows(items), "shingle_rows") if rows is None else rows
    left, done = Rounds(spark, "unsettled"), Rounds(spark, "founders")
    open_ = left.next(items.select("grp", "pos"))
    found = done.next(open_.where("false"))
    while not open_.isEmpty():
        mine = rows.join(open_, ["grp", "pos"], "left_semi")
        held = mine.groupBy("grp", "s").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c").cast("double") * F.col("c")), F.lit(0.0))).first()[0]
        size = mine.select("grp", "pos", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if held <= PAIRS * size:
            break
        block = open_.withColumn("__k", F.row_number().over(Window.partitionBy("grp").orderBy("pos"))).where(F.col("__k") <= BLOCK).select("grp", "pos")
        fresh = written(block.join(items, ["grp", "pos"]).select("grp", "pos", "sh").groupBy("grp").applyInPandas(_founders_of(least), items.select("grp", "pos").schema), "new_founders")
        taken = _alike(mine.join(fresh, ["grp", "pos"], "left_semi"), mine, least).select("grp", F.col("b").alias("pos"))
        gone = written(taken.union(block).distinct(), "settled")
        found = done.next(found.union(fresh))
        open_ = left.next(open_.join(gone, ["grp", "pos"], "left_anti"))
    mine = rows.join(open_, ["grp", "pos"], "left_semi")
    pairs = written(_alike(mine, mine, least).select("grp", "a", "b"), "alike")
    while not open_.isEmpty():
        wait = pairs.join(open_.withColumnRenamed("pos", "a"), ["grp", "a"], "left_semi")
        fresh = written(open_.join(wait.select("grp", F.col("b").alias("pos")), ["grp", "pos"], "left_anti"), "new_founders")
        taken = pairs.join(fresh.withColumnRenamed("pos", "a"), ["grp", "a"], "left_semi").select("grp", F.col("b").alias("pos"))
        gone = written(taken.union(fresh).distinct(), "settled")
        found = done.next(found.union(fresh))
        open_ = left.next(open_.join(gone, ["grp", "pos"], "left_anti"))
    return found


def clusters(items: DataFrame, least: float) -> DataFrame:
    """items (grp, pos long, id, sh; positions of a group differ): grp, id, pos, founder (its position), sim: of the founders before it the one it resembles most, the
    earliest of equals; a founder has itself. Sets that are equal are settled once; an item without shingles resembles nothing."""
    items = written(items.select("grp", F.col("pos").cast("long").alias("pos"), "id", F.array_sort(F.array_distinct("sh")).alias("sh")), "items")
    full = written(items.where(F.size("sh") > 0).select("grp", "pos", "id", F.sha2(F.concat_ws(",", F.col("sh").cast("array<string>")), 256).alias("sig")), "members")
    reps = written(full.groupBy("grp", "sig").agg(F.min("pos").alias("rep")), "classes")
    first = items.select("grp", "pos", "sh").join(reps.select("grp", F.col("rep").alias("pos")), ["grp", "pos"], "left_semi")
    rows = written(shared_rows(first), "shingle_rows")
    lead = founders(first, least, rows)
    near = _alike(rows.join(lead, ["grp", "pos"], "left_semi"), rows, least).select("grp", F.col("a").alias("founder"), F.col("b").alias("rep"), "sim")
    later = _alike(rows, rows.join(lead, ["grp", "pos"], "left_semi"), least).select("grp", F.col("b").alias("founder"), F.col("a").alias("rep"), "sim")
    own = lead.select("grp", F.col("pos").alias("founder"), F.col("pos").alias("rep"), F.lit(1.0).alias("sim"))
    # a copy may stand behind founders that its first text stands before, so those count for it as well
    options = written(near.unionByName(later).unionByName(own), "options")
    member = full.join(reps, ["grp", "sig"]).select("grp", "pos", "id", "rep")
    fits = member.join(options, ["grp", "rep"]).where("founder <= pos")
    best = fits.groupBy("grp", "pos", "id").agg(F.max(F.struct("sim", (-F.col("founder")).alias("f"))).alias("o")).select("grp", "id", "pos", (-F.col("o.f")).alias("founder"), "o.sim")
    return best.unionByName(items.where(F.size("sh") == 0).select("grp", "id", "pos", F.col("pos").alias("founder"), F.lit(1.0).alias("sim")))
