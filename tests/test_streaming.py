import datetime

from tessera.operators import ingest
from tessera.streaming import stateful

CALLS = "key string, call_id long, ts timestamp, ok boolean"


def stream(spark, tmp_path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return spark.table(name).collect()


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_rate_limit_denies_and_forgets(spark, tmp_path):
    rows = [[("a", i, at(i), True) for i in range(5)], [("a", 10, at(12), True), ("b", 11, at(0), True)]]
    got = {r.call_id: r.allowed for r in collected(stateful.rate_limited(stream(spark, tmp_path, rows), 3, 10.0), spark, "limits")}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 10: True, 11: True}


def test_breaker_opens_sheds_and_recovers():
    calls = [(0, False), (1, False), (2, False), (10, True), (40, False), (50, True), (101, True), (102, False)]
    phases, state = stateful.breaker(calls, ("closed", 0, 0.0, 0))
    assert phases == ["closed", "closed", "open", "shed", "open", "shed", "closed", "closed"] and state[0] == "closed"


def test_breaker_stream_keeps_state(spark, tmp_path):
    rows = [[("p", i, at(i), False) for i in range(2)], [("p", 2, at(2), False), ("p", 3, at(3), True)]]
    df = stream(spark, tmp_path, rows).withColumnRenamed("key", "provider")
    got = {r.call_id: r.phase for r in collected(stateful.breakers(df), spark, "breakers")}
    assert got == {0: "closed", 1: "closed", 2: "open", 3: "shed"}


def test_ingest_upserts_and_replays_once(spark, tmp_path):
    rows = [[("a", 1, at(0), True), ("b", 2, at(0), True)], [("a", 3, at(1), False)]]
    source = stream(spark, tmp_path, rows)
    merge = lambda old, new: ingest.merged(old, new, ["key"]) if old is not None else new
    for _ in range(2):
        q = stateful.ingest(source, str(tmp_path / "out"), str(tmp_path / "cp"), merge).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "gen=1")).select("key", "call_id", "ok").collect())
    assert got in ([("a", 3, False), ("b", 2, True)], [("a", 1, True), ("b", 2, True)])


def test_sessions_close_after_the_gap(spark, tmp_path):
    rows = [[("a", 1, at(0), True), ("a", 2, at(60), True)], [("a", 3, at(9 * 3600), True)], [("a", 4, at(30 * 3600), True)]]
    got = collected(stateful.sessions(stream(spark, tmp_path, rows), "key", "ts", "1 hour", "1 minute"), spark, "sessions_out")
    assert sorted(r.turns for r in got) == [1, 2]


def test_progress_is_emitted(spark, tmp_path):
    import time

    seen = []
    listener = stateful.progress_listener(lambda event, data: seen.append((event, data)))
    spark.streams.addListener(listener)
    try:
        collected(stream(spark, tmp_path, [[("a", 1, at(0), True)]]), spark, "progress_out")
        until = time.time() + 20
        while time.time() < until and not any(e == "done" for e, _ in seen):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [e for e, _ in seen][0] == "started" and any(e == "progress" and d["rows"] == 1 for e, d in seen)
