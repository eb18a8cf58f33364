import datetime

import pytest

from tessera.streaming import timers


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    key, value = timers.PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def run(spark, tmp_path, batches, schema, make, name):
    """One micro-batch for each of the given batches, the stream restarted between them on its checkpoint."""
    rows = []
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_rate_limit_with_late_and_repeated_rows(spark, tmp_path, rocks):
    schema = "key string, call_id long, ts timestamp"
    batches = [
        [("a", i, at(i)) for i in (0, 1, 2, 4)],
        [("a", 2, at(2)), ("a", 3, at(3)), ("a", 10, at(10.5)), ("b", 11, at(5))],  # 2 again, 3 late but within the watermark
        [("a", 20, at(4000))],
        [("a", 21, at(4001)), ("a", 22, at(1))],  # 22 is behind the watermark
    ]
    got = run(spark, tmp_path, batches, schema, lambda s: timers.rate_limited(s, 3, 10.0, "60 seconds"), "limits")
    seen = {}
    for r in got:
        seen.setdefault(r.call_id, []).append(r.allowed)
    assert seen == {0: [True], 1: [True], 2: [True, True], 4: [False], 3: [False], 10: [True], 11: [True], 20: [True], 21: [True]}


def test_breaker_is_half_opened_by_its_timer_and_probed_once(spark, tmp_path, rocks):
    schema = "provider string, call_id long, ts timestamp, ok boolean"
    batches = [
        [("p", 1, at(0), False), ("p", 2, at(1), False), ("p", 3, at(2), False), ("p", 4, at(3), True)],  # opens at 2, until 32
        [("q", 50, at(40), True)],  # the watermark passes 32: the timer speaks, with no call of p
        [("q", 51, at(41), True)],
        [("p", 5, at(42), None), ("p", 6, at(43), True), ("q", 52, at(44), True)],  # 5 probes, 6 is shed
        [("q", 53, at(60), True)],  # the lease ends at 52
        [("q", 54, at(61), True)],
        [("p", 7, at(62), None), ("p", 7, at(63), False)],  # a new probe fails: open until 123
        [("p", 7, at(63), False), ("p", 8, at(64), True)],  # delivered again; shed
        [("p", 9, at(124), None), ("p", 9, at(125), True), ("p", 10, at(126), False)],
    ]
    got = run(spark, tmp_path, batches, schema, lambda s: timers.breakers(s, 3, 30.0, late="2 seconds"), "phases")
    of = lambda call, provider="p": sorted(r.phase for r in got if r.call_id == call and r.provider == provider)
    assert [of(i) for i in (1, 2, 3, 4)] == [["closed"], ["closed"], ["open"], ["shed"]]
    assert of(5) == ["probe"] and of(6) == ["shed"] and of(7) == ["open", "probe", "seen"] and of(8) == ["shed"]
    assert of(9) == ["closed", "probe"] and of(10) == ["closed"] and of(54, "q") == ["closed"]
    assert of(-1)[:2] == ["half_open", "lease_lost"]
