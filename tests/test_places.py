import math
import random

from pyspark.sql import functions as F

from tessera.operators import serving
from tessera.operators.serving import Spec, autocomplete, geo_join, place_search

PLACE = "place_id long, name string, category string, lat double, lon double, admin_unit_id long, status string, confidence double, freshness double, rating double, review_count int, source_count int, open_now boolean"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


def places(spark, names):
    return spark.createDataFrame([(i, n, "food", 10.0, 106.0, 1, "open", 0.5, 0.5, 4.0, 9, 2, i % 2 == 0) for i, n in enumerate(names)], PLACE)


def found(df):
    return {r.place_id for r in df.collect()}


def test_geo_join_at_every_latitude(spark):
    rng = random.Random(4)
    for lat0, lon0, radius in ((0, 10, 1000), (60, 10, 1000), (60, 179.999, 1000), (-75, -180, 20_000), (89.99, 0, 3000), (85, 100, 300_000), (-90, 0, 50_000), (45, 0, 5_000_000)):
        spread = radius / 111_000 * 2
        spot = lambda: (max(-90.0, min(90.0, lat0 + rng.uniform(-spread, spread))), (lon0 + rng.uniform(-1, 1) * min(180, spread / max(math.cos(math.radians(lat0)), 0.01)) + 180) % 360 - 180)  # noqa: B023, E731
        a, b = [(i, *spot()) for i in range(40)], [(i, *spot()) for i in range(60)]
        got = {(r.id, r.place_id) for r in geo_join(spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "place_id int, lat double, lon double"), radius).collect()}
        want = {(i, j) for i, y, x in a for j, v, u in b if metres(y, x, v, u) <= radius}
        assert got == want and len(want) > 20, (lat0, lon0, radius, len(got), len(want))


def test_queries_are_folded_and_every_word_counts(spark):
    p = places(spark, ["Phở Thìn Lò Đúc", "Pho bo", "Bún chả", "Thìn Phở", None, ""])
    assert found(place_search(p, Spec(q="phở"))) == found(place_search(p, Spec(q="PHO"))) == {0, 1, 3}
    assert found(place_search(p, Spec(q="thin pho"))) == found(place_search(p, Spec(q="Thìn  PHỞ"))) == {0, 3}
    assert place_search(p, Spec(q="phở thìn")).count() == 2 and place_search(p, Spec(q="đúc")).first().place_id == 0
    assert place_search(p, Spec(q="bo pho")).count() == 1 and place_search(p, Spec(q="phở chả")).count() == 0
    assert place_search(p, Spec(q="bun  cha")).first().place_id == 2 and place_search(p, Spec()).count() == 6


def test_autocomplete_folds_and_takes_the_last_word_as_begun(spark):
    p = places(spark, ["Phở Thìn", "Pho bo", "Thìn", None])
    assert found(autocomplete(p, "phở")) == found(autocomplete(p, "pho")) == {0, 1}
    assert found(autocomplete(p, "pho th")) == found(autocomplete(p, "thìn p")) == {0}
    assert found(autocomplete(p, "ph thin")) == set() and found(autocomplete(p, "p")) == set()


def test_open_now_filters_before_the_cut(spark):
    p = places(spark, [f"Quán {i}" for i in range(300)]).withColumn("relevance", F.lit(0.0)).withColumn("distance_m", F.lit(None).cast("double"))
    got = serving.open_filtered(p, Spec(limit=100), False)
    assert got.count() == 100 and all(r.place_id % 2 for r in got.collect())
