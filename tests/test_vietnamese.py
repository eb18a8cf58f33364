import pytest
from pyspark.sql import functions as F

from tessera.functions import addresses, labels, understanding

PARSED = [
    ("Số 12 ngõ 45 Trần Duy Hưng, phường Trung Hòa, quận Cầu Giấy, Hà Nội", ("12", "Ngõ 45", "Trần Duy Hưng", "Trung Hòa", "Cầu Giấy", "Thành phố Hà Nội")),
    ("12/3B Đường 3/2, P. Xuân Khánh, Q. Ninh Kiều, TP. Cần Thơ", ("12/3B", "", "Đường 3/2", "Xuân Khánh", "Ninh Kiều", "Thành phố Cần Thơ")),
    ("TP. HCM, Quận 1", ("", "", "", "", "1", "Thành phố Hồ Chí Minh")),
    ("phố Hàng Bạc, Hoàn Kiếm, ha noi", ("", "", "Phố Hàng Bạc", "", "Hoàn Kiếm", "Thành phố Hà Nội")),
    ("5 Lê Lợi, Bến Nghé, Quận 1, SG", ("5", "", "Lê Lợi", "Bến Nghé", "1", "Thành phố Hồ Chí Minh")),
    ("hẻm 12a", ("", "Hẻm 12A", "", "", "", "")),
    ("", ("", "", "", "", "", "")),
    (None, ("", "", "", "", "", "")),
]


def test_addresses(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PARSED)], "id int, a string")
    got = {r.id: tuple(r[f] for f in addresses.FIELDS) for r in addresses.parsed(rows, "a").collect()}
    assert got == {i: want for i, (_, want) in enumerate(PARSED)}
    marked = {r.id: r.is_address for r in addresses.looks_like(addresses.parsed(rows, "a"), "a").collect()}
    assert marked == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False}
    one = spark.createDataFrame([("  12 a ,b /c -d  3x",)], "a string")
    assert one.select(addresses.normalized(F.col("a"))).first()[0] == "12 A, B/c-d 3X"


def test_categories(spark):
    rows = spark.createDataFrame([(1, "Nhà Thuốc Tây An", None), (2, None, '{"amenity": "bar", "types": ["x"]}'), (3, "???", '{"types": ["zzz", "book_store"]}'), (4, "", None), (5, "ga", None), (6, "gaz", None)], "id int, raw string, payload string")
    got = {r.id: r.c for r in rows.select("id", labels.category(labels.candidates(F.col("raw"), F.col("payload"))).alias("c")).collect()}
    assert got == {1: "health", 2: "food", 3: "retail", 4: None, 5: "transport", 6: None}
    overlay = {("p", "xyz"): "office", ("*", "xyz"): "food", ("p", "ga"): "worship"}
    rows = spark.createDataFrame([("p", "XYZ"), ("q", "xyz"), ("p", "ga"), ("q", "ga"), (None, "nope")], "provider string, raw string").withColumn("seq", F.monotonically_increasing_id())
    got = [r[0] for r in rows.select(labels.resolved(F.array("raw"), F.col("provider"), overlay)).collect()]
    assert got == ["office", "food", "worship", "transport", None]
    assert [tuple(r) for r in labels.unknown_labels(rows, overlay).collect()] == [("", "nope", "nope", 1)]


@pytest.mark.parametrize("q,variants,parts", [
    ("so sánh iphone và samsung", ["so sánh iphone và samsung", "iphone", "samsung"], ["iphone", "samsung"]),
    ("what is rust", ["what is rust", "what is rust meaning definition", "what is rust docs example"], ["what is rust"]),
    ("please how to deploy", ["how to deploy", "how to deploy example tutorial"], ["please how to deploy"]),
    ("iPhone 17 giá và pin", ["iPhone 17 giá và pin"], ["iPhone 17 giá", "iPhone 17 pin"]),
    ("latest news", ["latest news", "latest news 2024"], ["latest news"]),
    ("a and b and c", ["a and b and c"], ["a", "b c"]),
    ("", [""], [""]),
])
def test_rewrites_and_parts(spark, q, variants, parts):
    row = spark.createDataFrame([(q,)], "q string").select(understanding.rewrites(F.col("q"), 2024), understanding.decomposed(F.col("q"))).first()
    assert (row[0], row[1]) == (variants, parts)
