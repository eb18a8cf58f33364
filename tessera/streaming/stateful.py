"""Stateful streams: rate limits, circuit breakers, sessions, deduplicated ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, ts: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """A row for each session once `late` has passed since its end."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("turns"), F.min(ts).alias("started"), F.max(ts).alias("last_seen"))


def hourly(events: DataFrame, ts: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of hour windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


def allowed(times: list[float], held: list[float], limit: int, window_s: float) -> tuple[list[bool], list[float]]:
    """For each time, in order, whether it is let through: fewer than `limit` let through in the
    window before it. Denied calls aren't held."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window_s]
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held.append(t)
    return out, held


def rate_limited(calls: DataFrame, limit: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """calls (key string, call_id long, ts timestamp): call_id and allowed. State: the times of at most `limit`
    calls a key; it goes once the watermark has passed them by the window."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        ok, held = allowed([t.timestamp() for t in frame["ts"]], held, limit, window_s)
        state.update((held,))
        last = max([*held, frame["ts"].iloc[-1].timestamp()])
        state.setTimeoutTimestamp(max(int((last + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "call_id": frame["call_id"].to_numpy(), "allowed": ok})

    return calls.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "key string, call_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(outcomes: list[tuple[float, bool]], state: tuple, trips: int = 3, base_s: float = 30.0, cap_s: float = 600.0) -> tuple[list[str], tuple]:
    """State (phase, failures in a row, opened at, times opened). Closed opens after `trips`
    failures; open turns half-open after base x 2**(times - 1) seconds, cap_s at most; half-open closes on
    a success and opens again on a failure. A call while open is shed and changes nothing."""
    phase, failures, opened, times = state
    out = []
    for t, ok in outcomes:
        if phase == "open" and t >= opened + min(cap_s, base_s * 2 ** (times - 1)):
            phase = "half_open"
        if phase == "open":
            out.append("shed")
            continue
        if ok:
            phase, failures, times = "closed", 0, (0 if phase == "half_open" else times)
        else:
            failures += 1
            if phase == "half_open" or failures >= trips:
                phase, opened, times, failures = "open", t, times + 1, 0
        out.append(phase)
    return out, (phase, failures, opened, times)


def breakers(calls: DataFrame, trips: int = 3, base_s: float = 30.0) -> DataFrame:
    """calls (provider string, call_id long, ts timestamp, ok boolean): the phase after each call, or shed."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held = tuple(state.get) if state.exists else ("closed", 0, 0.0, 0)
        frame = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        phases, held = breaker(list(zip([t.timestamp() for t in frame["ts"]], frame["ok"], strict=True)), held, trips, base_s)
        state.update(held)
        yield pd.DataFrame({"provider": key[0], "call_id": frame["call_id"].to_numpy(), "phase": phases})

    return calls.groupBy("provider").applyInPandasWithState(run, "provider string, call_id long, phase string", "phase string, failures int, opened double, times int", "append", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; later ones, and late ones, go."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def ingest(rows: DataFrame, path: str, checkpoint: str, merge):
    """Merge each micro-batch into the table at `path` through merge(target or None,
    batch). A batch is written as a new generation and named in a pointer file only once it is whole; the
    stream's checkpoint holds the cursor, so a batch that is replayed finds its generation and is skipped."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/gen={n}/_SUCCESS"))
        if done(number):
            return
        target = spark.read.parquet(f"{path}/gen={number - 1}") if number and done(number - 1) else None
        merge(target, batch).write.mode("overwrite").parquet(f"{path}/gen={number}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def progress_listener(emit):
    """A StreamingQueryListener that gives (event, data) to emit: started, progress (rows, rows a second, batch) and
    done, as a server's event stream would send them."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            emit("started", {"id": str(event.id), "name": event.name})

        def onQueryProgress(self, event):
            p = event.progress
            emit("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            emit("done", {"id": str(event.id), "error": event.exception})

    return Listener()
