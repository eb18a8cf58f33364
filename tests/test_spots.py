from pyspark.sql import functions as F

from tessera.operators import serving


def test_rows_of_one_spot_meet_the_places_once(spark):
    left = spark.range(50).select("id", (F.col("id") % 2 * 0.01 + 10.0).alias("lat"), F.lit(106.0).alias("lon"), F.lit("x").alias("more"))
    right = spark.range(4).select(F.col("id").alias("place_id"), (F.col("id") * 0.01 + 10.0).alias("lat"), F.lit(106.0).alias("lon"))
    out = serving.geo_join(left, right, 1200.0)
    got = {(r.id, r.place_id) for r in out.collect()}
    assert got == {(i, p) for i in range(50) for p in range(4) if abs(i % 2 - p) <= 1} and out.count() == len(got)
    assert out.columns == ["id", "lat", "lon", "more", "place_id", "plat", "plon", "distance_m"]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()  # distinct spots before the cells are met
