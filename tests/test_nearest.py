import math
import random
import time

from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.operators.nearest import nearest


def apart(a, b):
    (y, x), (v, u) = (tuple(map(math.radians, p)) for p in (a, b))
    return (math.cos(y) * math.cos(x) - math.cos(v) * math.cos(u)) ** 2 + (math.cos(y) * math.sin(x) - math.cos(v) * math.sin(u)) ** 2 + (math.sin(y) - math.sin(v)) ** 2


def brute(s, p, most):
    out = {}
    for i, lat, lon, *k in s:
        mine = [(math.inf if None in (lat, lon, a, b) else round(apart((lat, lon), (a, b)), 15), j) for j, a, b, *q in p if q == k]
        out[i] = {j for _, j in sorted(mine)[:most]}
    return out


def table(spark, rows, ident):
    return spark.createDataFrame(rows, f"{ident} long, lat double, lon double, admin int, token string").repartition(3)


def test_the_nearest_are_among_the_found(spark):
    rng = random.Random(5)
    spot = lambda: rng.choice([(None, None), (10.5, 106.5), (rng.uniform(10, 11), rng.uniform(106, 107)), (10 + rng.gauss(0, 0.001), 106 + rng.gauss(0, 0.001)), (rng.uniform(-80, 80), rng.uniform(-180, 180))])
    group = lambda: rng.choice([(1, "cafe")] * 8 + [(1, "bar"), (2, "cafe")])
    p = [(i, *spot(), *group()) for i in range(6000)]
    s = [(i, *spot(), *group()) for i in range(300)]
    got = {}
    for r in nearest(table(spark, s, "s_id"), table(spark, p, "p_id"), ["admin", "token"], 20).collect():
        got.setdefault(r.s_id, set()).add(r.p_id)
    want = brute(s, p, 20)
    assert all(want[i] <= got.get(i, set()) for i in want) and sum(map(len, got.values())) < 2 * sum(map(len, want.values()))


def test_a_hot_token_gives_the_same_best_and_no_product(spark, monkeypatch):
    """20,000 places of one unit share a word: the pairs are a few for each record, and the best of a sample are those of a full comparison."""
    n = 20_000
    cols = ["id", "name", "phone", "domain", "admin", "lat", "lon"]
    rows = lambda k, seed: spark.range(k).select("id", F.lit("cafe mai").alias("name"), F.when(F.col("id") % 500 == 0, F.col("id").cast("string")).alias("phone"), F.lit(None).cast("string").alias("domain"), F.lit(7).alias("admin"), (F.rand(seed) + 10).alias("lat"), (F.rand(seed + 1) + 106).alias("lon")).select(*cols)
    p, s = (spark.createDataFrame(x.collect(), x.schema) for x in (rows(n, 3), rows(2000, 5)))
    began = time.time()
    got = resolution.block_pairs(s, p, 500.0, 50).select("s_id", "p_id", "place_rank").collect()
    assert len(got) == 2000 * 50 and time.time() - began < 240
    some = s.where("id % 100 = 0")
    monkeypatch.setattr(resolution, "HOT", 10**9)
    want = {tuple(r) for r in resolution.block_pairs(some, p, 500.0, 50).select("s_id", "p_id", "place_rank").collect()}
    assert want == {tuple(r) for r in got if r.s_id % 100 == 0}
