from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import gazetteer

UNITS = [
    ("vn1", "Bắc Ninh", "bac ninh", 1, None, "current"), ("vn2", "Bắc Giang", "bac giang", 1, None, "merged"), ("vn3", "Hà Nội", "ha noi", 1, None, "current"),
    ("d1", "Yên Dũng", "yen dung", 2, "vn2", "dissolved"), ("c1", "Tân An", "tan an", 3, "d1", "merged"), ("c2", "Tân An", "tan an", 3, "vn3", "current"), ("c3", "Cảnh Thụy", "canh thuy", 3, "vn1", "current"), ("c4", "Lẻ Loi", "le loi", 3, None, "dissolved"),
]
MOVES = [("vn2", "vn1", "merged_into"), ("c1", "c3", "merged_into"), ("vn3", "vn1", "unrelated")]


def tables(spark):
    units = spark.createDataFrame(UNITS, "key string, name string, normalized_name string, admin_level int, parent_key string, status string")
    return units, spark.createDataFrame([("vn3", "hn")], "unit_key string, normalized_alias string"), spark.createDataFrame(MOVES, "from_key string, to_key string, relation_type string")


def test_resolution(spark):
    asked = ["Xã Tân An, huyện Yên Dũng, tỉnh Bắc Giang", "Tân An", "Tân An, HN", "nowhere", "", None, "Bắc Ninh", "Lẻ Loi"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {r.query_id: (r.status, r.matched, r.current, r.confidence) for r in gazetteer.resolve(q, *tables(spark)).collect()}
    # the ward of the old province: merged wards lead to c3, the district and the province to the new province
    assert got[0] == ("resolved", ["c1", "d1", "vn2"], ["c3", "vn1"], 0.85)
    assert got[1][0] == "ambiguous" and got[1][3] == 0.5
    assert got[2] == ("resolved", ["c2", "vn3"], ["c2", "vn3"], 0.9)
    assert got[3] == got[4] == got[5] == ("not_found", [], [], 0.0)
    assert got[6] == ("resolved", ["vn1"], ["vn1"], 1.0)
    assert got[7] == ("resolved", ["c4"], [], 1.0)


def test_lookup_prefers_whole_then_longest_then_current(spark):
    units = spark.createDataFrame([("a", "Tỉnh Bắc Ninh", ["Kinh Bắc"], True), ("b", "Bắc Ninh", None, False), ("c", "Bà Rịa Vũng Tàu", None, False), ("d", "Vũng Tàu", None, True)], "key string, name string, aliases array<string>, is_current boolean")
    q = spark.createDataFrame(list(enumerate(["tỉnh Bắc Ninh", "bac ninh", "đi Bà Rịa-Vũng Tàu chơi", "ở vũng tàu", "kinh bắc", "vũng tàux", "", None])), "query_id int, text string")
    got = {r.query_id: (r.key, r.found) for r in gazetteer.lookup(q, units).collect()}
    assert got == {0: ("a", "exact"), 1: ("a", "exact"), 2: ("c", "contained"), 3: ("d", "contained"), 4: ("a", "exact"), 5: (None, None), 6: (None, None), 7: (None, None)}
    row = spark.createDataFrame([("quán ăn gần chợ Bến Thành?",), ("phở",), ("near x",)], "q string").select(gazetteer.anchor_phrase(F.col("q"))).collect()
    assert [r[0] for r in row] == ["chợ Bến Thành", None, None]


def test_rings_are_thinned_within_the_tolerance(spark):
    import math

    circle = [(math.cos(2 * math.pi * i / 400), math.sin(2 * math.pi * i / 400)) for i in range(401)]
    out = gazetteer.thinned_ring(circle, 0.01)
    assert out[0] == circle[0] and out[-1] == circle[-1] and 10 < len(out) < 80
    df = spark.createDataFrame([([[{"x": x, "y": y} for x, y in circle]],)], "r array<array<struct<x:double,y:double>>>")
    assert len(df.select(gazetteer.simplified(F.col("r"), 0.5, 30)).first()[0][0]) >= 30
    assert gazetteer.thinned([(0, 0), (1, 0.001), (2, 0)], 0.01) == [(0, 0), (2, 0)]


def test_haversine_km(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), geo.haversine_km(F.lit(21.0), F.lit(105.8), F.lit(10.8), F.lit(106.7))).first()
    assert abs(r[0] - math_pi_r()) < 1e-6 and 1130 < r[1] < 1145


def math_pi_r():
    import math

    return math.pi * 6371.0
