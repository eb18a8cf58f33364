import random

import pytest

from tessera.sources.keyed import KeyedTable

SCHEMA = "id long, name string, tags array<string>"


def rows(df):
    return sorted((r.id, r.name, tuple(r.tags or ())) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame([(i, n, list(t)) for i, n, t in data], SCHEMA)


def test_writes_equal_a_full_merge(spark, tmp_path):
    rng = random.Random(1)
    table = KeyedTable(spark, str(tmp_path / "t"), "id", 8, most_deltas=4)
    want = {i: (i, f"n{i}", ("a",)) for i in range(300)}
    table.rebuild(frame(spark, want.values()))
    for step in range(9):
        fresh = {i: (i, f"s{step}-{i}", ()) for i in rng.sample(range(350), 20)}
        gone = rng.sample(range(350), 15)
        table.upsert(frame(spark, fresh.values()), spark.createDataFrame([(i,) for i in gone], "id long"))
        want = {i: r for i, r in want.items() if i not in gone} | fresh
        assert rows(table.read()) == sorted(want.values()) and len(table.state()["deltas"]) < 4
        key = rng.choice(sorted(want))
        assert rows(table.get(key)) == [want[key]]
    assert rows(table.get(9999)) == []
    table.compact()
    assert table.state()["deltas"] == [] and rows(KeyedTable(spark, str(tmp_path / "t"), "id").read()) == sorted(want.values())


def test_an_upsert_writes_its_rows_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", 16, most_deltas=2)
    table.rebuild(frame(spark, [(i, "x" * 20, ("t",)) for i in range(2000)]))
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    table.upsert(frame(spark, [(5, "new", ())]))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert {p: t for p, t in after.items() if p in stamps} == stamps and len(after) == len(stamps) + 1
    touched = table.state()["deltas"][0]["buckets"]
    table.upsert(frame(spark, [(5, "newer", ())]))  # the second delta: folded in
    left = {p for p in (tmp_path / "t").rglob("*.parquet")}
    assert all((p in left) == (f"bucket={touched[0]}" not in p.parts) for p in stamps) and table.get(5).first().name == "newer"


def test_awkward_writes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", 4)
    with pytest.raises(ValueError, match="no table"):
        table.read()
    table.upsert(frame(spark, [(1, "a", ("t",)), (2, None, ())]))
    with pytest.raises(ValueError, match="repeated"):
        table.rebuild(frame(spark, [(1, "a", ()), (1, "b", ()), (None, "c", ())]))
    before = table.state()
    assert table.upsert(frame(spark, [])) == before and table.upsert(frame(spark, [(None, "x", ())])) == before
    table.upsert(frame(spark, [(1, "b", ()), (1, "c", ())]), spark.createDataFrame([(1,), (2,), (7,), (None,)], "id long"))
    assert rows(table.read()) == [(1, "c", ())]
    table.upsert(spark.createDataFrame([(3, 9)], "id int, other int"))
    assert rows(table.read()) == [(1, "c", ()), (3, None, ())]
    table.delete(spark.createDataFrame([(1,), (3,)], "id long"))
    assert rows(table.read()) == []
    table.compact()
    assert rows(table.read()) == [] and rows(table.get(1)) == []
    table.rebuild(frame(spark, []))
    assert rows(table.read()) == []
