import pytest
from pyspark.sql import functions as F

from tessera.operators import projection
from tessera.sources.generations import Generations, append, load_units, split_payloads, synced, write_report


def docs(spark, *rows):
    return spark.createDataFrame(rows, "place_id string, name string")


def names(table):
    return sorted(map(tuple, table.select("place_id", "name").collect()))


def test_rebuild_swaps_and_drops_the_old(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "places"))
    assert g.state() == {} and g.migrate() == {"status": "unavailable"}
    with pytest.raises(ValueError):
        g.read()
    first = g.rebuild(docs(spark, ("1", "a"), ("2", "b")), {"ts": "2024-01-01", "id": 2})
    assert (first["generation"], first["docs_indexed"], first["replaced"]) == (1, 2, None)
    second = g.rebuild(docs(spark, ("1", "c")))
    assert (second["generation"], second["replaced"], g.epoch()) == (2, "g1", 2)
    assert names(g.read()) == [("1", "c")] and not (tmp_path / "places" / "g1").exists()


def test_upsert_delete_and_point_reads(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "places"))
    g.rebuild(docs(spark, ("1", "a"), ("2", "b"), ("3", "c")))
    assert g.upsert(docs(spark).where("false"), "place_id")["generation"] == 1  # nothing to do, nothing written
    g.upsert(docs(spark, ("2", "B"), ("4", "d")), "place_id", {"id": 4})
    assert names(g.read()) == [("1", "a"), ("2", "B"), ("3", "c"), ("4", "d")] and g.state()["cursor"] == {"id": 4}
    g.delete_where(F.col("place_id") == "1")
    assert sorted(r[0] for r in g.ids("place_id").collect()) == ["2", "3", "4"]
    assert names(g.get("place_id", "3")) == [("3", "c")] and g.get("place_id", "1").isEmpty()


def test_a_failed_rebuild_leaves_the_table_and_a_message(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "places"))
    g.rebuild(docs(spark, ("1", "a")))
    bad = docs(spark, ("1", "x")).withColumn("name", F.raise_error(F.lit("no luck")).cast("string"))
    with pytest.raises(Exception):
        g.rebuild(bad)
    assert names(g.read()) == [("1", "a")] and "no luck" in g.state()["last_error"]


def test_migration_keeps_the_old_generation_and_is_guarded(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "places"))
    g.rebuild(docs(spark, ("1", "a")))
    done = g.migrate(5, lambda t: t.withColumn("price_level", F.lit("$")))
    assert (done["status"], done["preserved"], done["generation"]) == ("done", "g1", 5) and (tmp_path / "places" / "g1").exists()
    assert g.read().columns == ["place_id", "name", "price_level"]
    assert g.migrate(5) == {"status": "skipped", "generation": 5}


def test_blobs_are_split_once_and_logs_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (3, "small"), (4, None)], "id int, raw_payload string")
    thin, blobs = split_payloads(rows, most=50)
    assert blobs.count() == 1 and {r.id: r.raw_payload for r in thin.collect()} == {1: None, 2: None, 3: "small", 4: None}
    for _ in range(2):
        append(rows, str(tmp_path / "log"), "id")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8
    write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4


def test_units_merge_by_code_and_era(spark):
    units = spark.createDataFrame([("u1", "A", None, "old a"), ("u9", "Z", "2020-01-01", "z")], "id string, code string, valid_from string, name string").withColumn("valid_from", F.col("valid_from").cast("date"))
    seed = spark.createDataFrame([("A", None, "new a", None), ("B", "2025-07-01", "b", "A")], "code string, valid_from string, name string, parent_code string").withColumn("valid_from", F.col("valid_from").cast("date"))
    got = {r.code: (r.id, r.name, r.parent_id) for r in load_units(units, seed).collect()}
    assert got == {"A": ("u1", "new a", None), "B": ("B@2025-07-01", "b", "u1"), "Z": ("u9", "z", None)}


def test_retries_are_bounded():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    assert synced(flaky) == 3
    with pytest.raises(OSError):
        synced(lambda: (_ for _ in ()).throw(OSError()), 2)


def test_projection_of_one_place(spark):
    place = spark.createDataFrame([(7, None, "Phở Hòa", "pho hoa", "food", "x", "+84", None, None, '"{\\"mon\\": []}"', 1.0, 2.0, 5, "weird", None, None, None, None, None, None, '["i1"]')], "place_id long, business_id long, canonical_name string, normalized_name string, canonical_category string, address string, phone string, website string, website_domain string, opening_hours string, lat double, lon double, admin_unit_id long, status string, confidence double, source_count int, rating double, review_count int, price_level string, primary_image_url string, images string").withColumns({"last_seen": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    found = spark.createDataFrame([(7, "PHỞ HÒA"), (7, " Pho 24 "), (7, "pho 24"), (7, ""), (7, None), (7, "pho hoa")], "place_id long, raw_name string")
    d = projection.project(place, found, F.expr("TIMESTAMP '2024-01-31 00:00:00'")).first()
    assert (d.place_id, d.business_id, d.aliases, d.status, d.confidence, d.freshness_score, d.source_count) == ("7", None, ["Pho 24"], "unknown", 0.0, 0.5, 0)
    assert (d.category_ids, d.phone, d.primary_image_url, d.opening_hours) == (["food"], ["+84"], "i1", '{"mon": []}')


def test_migrations_apply_once_in_order(spark, tmp_path):
    from tessera.sources.generations import migrated

    g = Generations(spark, str(tmp_path / "places"))
    g.rebuild(docs(spark, ("1", "a")))
    steps = [("one", lambda t: t.withColumn("x", F.lit(1))), ("two", lambda t: t.withColumn("y", F.col("x") + 1))]
    assert migrated(g, steps[:1]) == ["one"] and migrated(g, steps) == ["two"] and migrated(g, steps) == []
    assert tuple(g.read().select("x", "y").first()) == (1, 2)


def test_locks_have_owners_and_expire(spark, tmp_path):
    from tessera.sources.generations import Lock

    lock = Lock(spark, str(tmp_path / "locks"))
    assert lock.acquire("a", 30, 100.0, "t1") and not lock.acquire("a", 30, 110.0, "t2")
    assert not lock.release("a", "t2") and lock.acquire("a", 30, 200.0, "t3") and not lock.release("a", "t1") and lock.release("a", "t3")
    assert lock.acquire("a", 30, 201.0, "t4") and not lock.release("b", "x")
    with pytest.raises(ValueError):
        lock.acquire("a", 0, 1.0, "t")


def test_direct_rows(spark):
    from tessera.operators import providers

    rows = [("github", "a/b", '{"full_name": "A/B", "html_url": "http://g", "stargazers_count": 3}'), ("pypi", "p", '{"info": {"name": "P", "home_page": "", "version": "1"}}'), ("arxiv", "1", "<x/>"), ("wikipedia", "New York", '{"title": "New York", "extract": "city"}'), ("npm", "n", None), ("other", "o", "{}")]
    got = {r.entity_id: (r.name, r.type, r.url, r.metadata) for r in providers.direct_rows(spark.createDataFrame(rows, "entity_type string, entity_id string, body string")).collect()}
    assert got["a/b"] == ("A/B", "repository", "http://g", {"stars": "3", "forks": None, "language": None}) and got["p"][2] == "https://pypi.org/project/p/"
    assert got["1"] == ("1", "paper", "https://arxiv.org/abs/1", {}) and got["New York"][2].endswith("New_York") and set(got) == {"a/b", "p", "1", "New York"}
