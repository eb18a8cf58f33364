"""Tables kept as generations with a pointer to the current one, and their ledger.

A generation is a folder of Parquet files that never changes. The pointer and the ledger are one small JSON
file that is written beside and renamed into place, so readers see the old table or the new one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """The table at `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("state").getFileSystem(self._conf)

    def state(self) -> dict:
        """Generation, concrete (its folder), cursor, docs_indexed, last_error, epoch; empty before the first."""
        at = self._path("state.json")
        if not self._fs().exists(at):
            return {}
        stream = self._fs().open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, **changes) -> dict:
        now = self.state() | changes
        fs, temporary = self._fs(), self._path(".state.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(now, default=str).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(fs.makeQualified(temporary), fs.makeQualified(self._path("state.json")), options)
        return now

    def read(self) -> DataFrame:
        """The current generation."""
        state = self.state()
        if "concrete" not in state:
            raise ValueError(f"no generation at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{state['concrete']}")

    def rebuild(self, docs: DataFrame, cursor: dict | None = None, keep_old: bool = False) -> dict:
        """Docs as the next generation, whole before the pointer moves; the old one goes unless kept.
        A failure leaves the old one in place and its message in the ledger."""
        before = self.state()
        number = int(before.get("generation", 0)) + 1
        name = f"g{number}"
        try:
            docs.write.mode("overwrite").parquet(f"{self.root}/{name}")
            n = self.spark.read.parquet(f"{self.root}/{name}").count()
        except Exception as e:
            self._save(last_error=str(e)[:500])
            raise
        now = self._save(generation=number, concrete=name, docs_indexed=n, cursor=cursor, last_error=None, epoch=int(before.get("epoch", 0)) + 1)
        if before.get("concrete") and not keep_old:
            self._fs().delete(self._path(before["concrete"]), True)
        return now | {"replaced": before.get("concrete")}

    def apply(self, change, cursor: dict | None = None) -> dict:
        """change(current table) as the next generation."""
        return self.rebuild(change(self.read()), cursor if cursor is not None else self.state().get("cursor"))

    def upsert(self, rows: DataFrame, key: str, cursor: dict | None = None) -> dict:
        """Rows replace those of their key and the others stay; no rows: nothing is written."""
        if rows.isEmpty():
            return self.state()
        return self.apply(lambda t: t.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True), cursor)

    def delete_where(self, condition: Column) -> dict:
        """Rows for which the condition is true go."""
        return self.apply(lambda t: t.where(~F.coalesce(condition, F.lit(False))))

    def ids(self, key: str) -> DataFrame:
        """S44-S46."""
        return self.read().select(key)

    def get(self, key: str, value) -> DataFrame:
        """A filter that reaches the scan."""
        return self.read().where(F.col(key) == value)

    def migrate(self, generation: int | None = None, change=None) -> dict:
        """The current generation copied (or changed) into a newer one, the old one kept; skipped if the table
        has that generation already."""
        state = self.state()
        if not state:
            return {"status": "unavailable"}
        target = generation if generation is not None else int(state["generation"]) + 1
        if int(state["generation"]) >= target:
            return {"status": "skipped", "generation": state["generation"]}
        table = self.read()
        table = change(table) if change else table
        table.write.mode("overwrite").parquet(f"{self.root}/g{target}")
        now = self._save(generation=target, concrete=f"g{target}", epoch=int(state.get("epoch", 0)) + 1)
        return {"status": "done", "preserved": state["concrete"]} | now

    def epoch(self) -> int:
        """Changes with every generation; a cache that holds it in its keys forgets at once."""
        return int(self.state().get("epoch", 0))


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Append-only logs and snapshots, by day or provider where given."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def stage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A micro-batch as text columns, absent ones null, in the order given."""
    return rows.select(*[(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def split_payloads(rows: DataFrame, payload: str = "raw_payload", most: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(rows with payloads over `most` bytes replaced by their key, the blobs: key and payload, each once).
    The key is the content's SHA-256, so a blob written twice is the same blob."""
    body = F.col(payload)
    large = F.octet_length(body) > most
    key = F.concat(F.lit("blob/"), F.sha2(F.encode(body, "UTF-8"), 256))
    thin = rows.withColumn("payload_key", F.when(large, key)).withColumn(payload, F.when(~F.coalesce(large, F.lit(False)), body))
    return thin, rows.where(large).select(key.alias("payload_key"), body.alias(payload)).dropDuplicates(["payload_key"])


def load_units(units: DataFrame, seed: DataFrame) -> DataFrame:
    """A seed of administrative units merged by (code, valid_from, null as the first day): seed values win, known keys
    stay, and parents are resolved by code in a second pass."""
    era = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    old = units.withColumn("__era", era).select(F.col("code"), F.col("__era"), F.col("id").alias("__id"))
    rows = seed.withColumn("__era", era).join(old, ["code", "__era"], "left")
    fresh = F.concat_ws("@", "code", F.col("__era").cast("string"))
    rows = rows.withColumn("id", F.coalesce("__id", fresh)).drop("__id")
    parents = rows.select(F.col("code").alias("parent_code"), F.col("id").alias("parent_id"), F.col("__era").alias("__pera"))
    latest = parents.groupBy("parent_code").agg(F.max_by("parent_id", "__pera").alias("parent_id"))
    kept = units.withColumn("__era", era).join(seed.withColumn("__era", era).select("code", "__era"), ["code", "__era"], "left_anti").drop("__era")
    return rows.join(latest, "parent_code", "left").drop("__era").unionByName(kept, allowMissingColumns=True)


def dual_status(lexical: DataFrame, vector: DataFrame, key: str = "passage_id") -> DataFrame:
    """Passages of two stores: both, lexical_only or vector_only."""
    l, v = lexical.select(key, F.lit(True).alias("__l")), vector.select(key, F.lit(True).alias("__v"))  # noqa: E741
    return l.join(v, key, "full_outer").select(key, F.when(F.col("__l") & F.col("__v"), "both").when(F.col("__l"), "lexical_only").otherwise("vector_only").alias("sync_status"))


def write_report(report: DataFrame, path: str) -> None:
    """Reports and profiles as JSON lines."""
    report.write.mode("overwrite").json(path)


def synced(write, attempts: int = 3) -> int:
    """write() until it succeeds, `attempts` times at most; the last error is raised. Returns the attempts made."""
    for n in range(1, attempts + 1):
        try:
            write()
            return n
        except Exception:
            if n == attempts:
                raise
    raise ValueError("attempts must be positive")


def migrated(table: Generations, steps: list[tuple[str, object]]) -> list[str]:
    """Named changes (name, table -> table) in order, each once: the ledger keeps the names applied, so running them again,
    or more of them, applies only what is new. Returns what was applied now."""
    done = list(table.state().get("migrations", []))
    fresh = [(name, change) for name, change in steps if name not in done]
    for name, change in fresh:
        table.apply(change)
        done.append(name)
        table._save(migrations=done)
    return [name for name, _ in fresh]


class Lock:
    """A lock as a file of the shared folder, made only if it isn't there: a token for its owner, a time to live after which
    another may take it."""

    def __init__(self, spark: SparkSession, root: str):
        self._table = Generations(spark, root)

    def acquire(self, key: str, ttl_s: float, now: float, token: str) -> bool:
        if ttl_s <= 0:
            raise ValueError("a lock needs a time to live")
        fs, at = self._table._fs(), self._table._path(f"{key}.lock")
        if fs.exists(at):
            held = json.loads(self._table.spark.read.text(at.toString(), wholetext=True).collect()[0][0] or "{}")
            if held.get("until", 0) > now:
                return False
            fs.delete(at, False)
        try:
            out = fs.create(at, False)  # fails if another made it first
        except Exception:
            return False
        out.write(bytearray(json.dumps({"token": token, "until": now + ttl_s}).encode()))
        out.close()
        return True

    def release(self, key: str, token: str) -> bool:
        """Only the owner's token opens it."""
        fs, at = self._table._fs(), self._table._path(f"{key}.lock")
        if not token or not fs.exists(at):
            return False
        held = json.loads(self._table.spark.read.text(at.toString(), wholetext=True).collect()[0][0] or "{}")
        return held.get("token") == token and bool(fs.delete(at, False))
