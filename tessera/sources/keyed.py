"""A table by key that takes upserts and deletes as small delta files and merges them on reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .generations import Generations

#: Folders that keys are hashed to, deltas that are merged on reading before they are folded in, and delta rows whose keys may be broadcast.
BUCKETS, MOST_DELTAS, BROADCAST_ROWS = 32, 8, 200_000


class KeyedTable:
    """A table at `root`, a folder that driver and executors share, one row a key.

    Rows stand in folders by a hash of their key. An upsert or delete writes its own rows, and nothing else, as the next delta: new rows, and tombstones
    for keys that go. Reading takes the base without the keys of any delta, and of each such key the last row. A manifest that is
    renamed into place names the base folder of each bucket and the deltas, so readers see the state before a write or after it. Once there
    are `most_deltas`, the buckets that deltas touch, and no others, are rewritten (compact).
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.root, self.key, self.most_deltas = spark, root.rstrip("/"), key, most_deltas
        self._manifest = Generations(spark, root)
        self.buckets = self.state().get("buckets", buckets)

    def state(self) -> dict:
        """Number of the last write, columns, base folder of each bucket, deltas with their rows, epoch."""
        return self._manifest.state()

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def rebuild(self, rows: DataFrame) -> dict:
        """Rows as the whole table. A null or repeated key is an error, as the ledger then says, and leaves the table as it was."""
        number = self.state().get("number", 0) + 1
        self._write(rows, f"b{number}")
        kept = self._base_files(f"b{number}")
        n, keys = self.spark.read.schema(rows.schema).parquet(f"{self.root}/b{number}").agg(F.count("*"), F.count_distinct(self.key)).first()
        if n != keys:
            self._drop(f"b{number}")
            raise ValueError(f"{n - keys} rows have a null or repeated {self.key}")
        return self._moved(number, schema=rows.schema.json(), base={b: f"b{number}" for b in kept}, deltas=[])

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None) -> dict:
        """Rows replace those of their key or are new; keys in `deleted` go. No rows: nothing is written. Of rows that share a key one, the largest,
        counts; a key that is both new and deleted stays with its new row. Columns are those of the table; absent ones are null."""
        state = self.state()
        if not state:
            return self.rebuild(rows)
        if deleted is None and rows.isEmpty():
            return state
        schema = self._schema(state)
        named = rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        delta = named.where(F.col(self.key).isNotNull()).withColumn("__gone", F.lit(False))
        if deleted is not None:
            gone = deleted.select(F.col(self.key).cast(schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct().join(named.select(self.key), self.key, "left_anti")
            delta = delta.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        number = state["number"] + 1
        orderable = [f.name for f in schema if f.dataType.typeName() != "map"]
        # one exchange: rows of a key meet where their bucket goes, and a small delta is one file
        dealt = delta.withColumn("bucket", self._bucket()).repartition("bucket")
        last = dealt.groupBy("bucket", self.key).agg(F.max_by(F.struct(*delta.columns), F.struct(*orderable)).alias("r")).select("r.*", "bucket")
        seen = Observation()
        last.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set("bucket").alias("buckets")).write.mode("overwrite").parquet(f"{self.root}/d{number}")
        if not seen.get["rows"]:
            self._drop(f"d{number}")
            return state
        now = self._moved(number, deltas=[*state["deltas"], {"name": f"d{number}", "rows": seen.get["rows"], "buckets": sorted(seen.get["buckets"])}])
        return self.compact() if len(now["deltas"]) >= self.most_deltas else now

    def delete(self, keys: DataFrame) -> dict:
        """Keys (the key column) go; those that aren't there don't matter."""
        return self.upsert(self.spark.createDataFrame([], self._schema(self.state())), keys)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the manifest, or some of its buckets."""
        state = self.state()
        if not state:
            raise ValueError(f"no table at {self.root}")
        base, deltas = self._base(state, buckets), self._deltas(state, buckets)
        if deltas is None:
            return base
        columns = base.columns
        keys = deltas.select(self.key).distinct()
        rows = sum(d["rows"] for d in state["deltas"])
        keys = F.broadcast(keys) if rows <= BROADCAST_ROWS else keys  # else Spark chooses by size
        last = deltas.groupBy(self.key).agg(F.max_by(F.struct(*columns, "__gone"), "__number").alias("r")).where("not r.__gone")
        return base.join(keys, self.key, "left_anti").select(*columns).unionByName(last.select(*[F.col(f"r.{c}").alias(c) for c in columns]))

    def get(self, value) -> DataFrame:
        """One key's row, read from its bucket."""
        kind = self._schema(self.state())[self.key].dataType
        bucket = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.key)).select(self._bucket()).first()[0]
        return self.read([bucket]).where(F.col(self.key) == F.lit(value))

    def compact(self) -> dict:
        """Deltas folded into the buckets that they touch; the others' files stay as they are. Files that no manifest names any more go."""
        state = self.state()
        touched = sorted({b for d in state["deltas"] for b in d["buckets"]})
        if not touched:
            return state
        number = state["number"] + 1
        self._write(self.read(touched), f"b{number}")
        base = {int(b): n for b, n in state["base"].items() if int(b) not in touched} | {b: f"b{number}" for b in self._base_files(f"b{number}")}
        now = self._moved(number, base=base, deltas=[])
        for b, name in state["base"].items():
            if int(b) in touched:
                self._drop(f"{name}/bucket={b}")
        for d in state["deltas"]:
            self._drop(d["name"])
        return now

    def _moved(self, number: int, **changes) -> dict:
        return self._manifest._save(number=number, buckets=self.buckets, epoch=self.state().get("epoch", 0) + 1, **changes)

    def _schema(self, state: dict):
        return StructType.fromJson(json.loads(state["schema"]))

    def _write(self, rows: DataFrame, name: str) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
        dealt.sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def _base_files(self, name: str) -> list[int]:
        found = self._manifest._fs().globStatus(self._manifest._path(f"{name}/bucket=*")) or []
        return sorted(int(s.getPath().getName().rpartition("=")[2]) for s in found)

    def _drop(self, name: str) -> None:
        self._manifest._fs().delete(self._manifest._path(name), True)

    def _base(self, state: dict, buckets: list[int] | None) -> DataFrame:
        schema, out = self._schema(state), None
        for name in sorted(set(state["base"].values())):
            mine = [int(b) for b, n in state["base"].items() if n == name and (buckets is None or int(b) in buckets)]
            if mine:
                # buckets that a later folder has replaced, and those not asked for, are left out by the folder's name
                rows = self.spark.read.schema(StructType([*schema]).add("bucket", "integer")).parquet(f"{self.root}/{name}").where(F.col("bucket").isin(*mine)).select(*schema.names)
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _deltas(self, state: dict, buckets: list[int] | None) -> DataFrame | None:
        schema = self._schema(state).add("__gone", "boolean").add("bucket", "integer")
        out = None
        for d in state["deltas"]:
            if buckets is None or set(buckets) & set(d["buckets"]):
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{d['name']}").withColumn("__number", F.lit(int(d["name"][1:])))
                rows = rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))
                out = rows if out is None else out.unionByName(rows)
        return out
