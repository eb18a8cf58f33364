"""Composite scores against the formulas written out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, resolution, serving

PLACES = "place_id long, category string, lat double, lon double, status string, confidence double, freshness double, rating double, review_count int, source_count int, open_now boolean, relevance double, distance_m double"


def rank(spark, rows, **spec):
    df = spark.createDataFrame(rows, PLACES)
    return serving.ranked(df, serving.Spec(**spec)).collect()


def test_place_rank_components(spark):
    rows = [(1, "food", 0.0, 0.0, "open", 0.9, 0.8, 4.8, 2500, 2, True, 6.0, 375.0), (2, "retail", 0.0, 0.0, None, None, None, None, None, 9, None, 3.0, None), (3, "health", 0.0, 0.0, "temporarily_closed", 2.0, -1.0, 5.0, 0, 0, False, None, 0.0), (4, None, 0.0, 0.0, "permanently_closed", 0.0, 0.0, 1.0, 10, 3, None, -1.0, 1500.0)]
    got = {r.place_id: r.score for r in rank(spark, rows, category="food")}
    bayes = lambda r, n: (r * n + 10 * 3.5) / (n + 10) / 5
    popular = lambda n: min(1.0, math.log1p(n) / math.log1p(1000))
    want = {
        1: 0.30 * 1 + 0.20 * math.exp(-0.5) + 0.08 * 1 + 0.08 * 0.9 + 0.07 * 0.8 + 0.06 * 2 / 3 + 0.06 * 1 + 0.06 * bayes(4.8, 2500) + 0.04 * 1 + 0.05 * 1,
        2: 0.30 * 0.5 + 0.20 * 0.5 + 0.08 * 0.6 + 0 + 0 + 0.06 * 1 + 0.06 * 0.6 + 0.06 * 0.7 + 0 + 0.05 * 0.5,
        3: 0 + 0.20 * 1 + 0 + 0.08 * 1 + 0 + 0 + 0.06 * 0.25 + 0.06 * 0.7 + 0 + 0,
        4: 0 + 0.20 * math.exp(-2) + 0.08 * 0.3 + 0 + 0 + 0.06 * 1 + 0 + 0.06 * bayes(1, 10) + 0.04 * popular(10) + 0.05 * 0.5,
    }
    assert got == pytest.approx(want, abs=1e-8)
    assert [r.place_id for r in rank(spark, rows, sort="distance")] == [3, 1, 4, 2]
    assert [r.place_id for r in rank(spark, rows, sort="popularity")] == [1, 4, 2, 3]
    assert [r.place_id for r in rank(spark, rows, sort="rating", limit=1)] == [1]


def test_weights_from_json():
    assert serving.weights_of(None) == serving.WEIGHTS == serving.weights_of("[1]") == serving.weights_of("{bad")
    assert serving.weights_of('{"text": 0.5, "nope": 1, "distance": -1, "status": "x"}') == serving.WEIGHTS | {"text": 0.5}
    assert abs(sum(serving.WEIGHTS.values()) - 1) < 1e-9


def test_provider_health(spark):
    calls = [("a", "success", 100.0, 10, 3), ("a", "empty", 200.0, 0, 0), ("a", "captcha", 9000.0, 0, 0), ("a", "timeout", 8000.0, 0, 0), ("b", "success", 5000.0, 1, 0)]
    rows = {r.provider: r for r in evaluation.provider_health(spark.createDataFrame(calls, "provider string, outcome string, latency_ms double, result_count int, usable_result_count int"), "provider", 3000.0).collect()}
    a = rows["a"]  # the median by rounded index of four values is the third: 1.5 rounds to 2
    assert (a.p50_latency_ms, a.p95_latency_ms, a.success_rate, a.ok_rate, a.relevant_result_rate) == (8000.0, 9000.0, 0.25, 0.5, 0.25)
    assert a.health_score == pytest.approx(0.55 * (1 + 0.5 + 0 + 0.1) / 4 + 0.20 * 0.5 + 0.15 * 3000 / 8000 + 0.10 * 0.75, abs=1e-6) and a.status == "degraded"
    assert rows["b"].health_score == pytest.approx(0.55 + 0.20 * 0.2 + 0.15 * 0.6 + 0.10, abs=1e-6) and rows["b"].status == "healthy"


def test_engines_are_disabled(spark):
    calls = [("x", i, "success") for i in range(5)] + [("y", i, "error" if i > 4 else "success") for i in range(12)] + [("z", i, "error") for i in range(4)] + [("w", i, "captcha" if i % 5 == 0 else "empty") for i in range(10)]
    got = {r.engine: (r.consecutive_failures, r.disabled) for r in evaluation.engine_rates(spark.createDataFrame(calls, "engine string, ts int, outcome string"), "engine").collect()}
    assert got == {"x": (0, False), "y": (7, True), "z": (4, False), "w": (0, True)}


@pytest.mark.parametrize("n,ms,rel,domains,error,want", [
    (3, 0, [0.5, 1.0], ["a", "b", "a", ""], None, (0.30 + 0.30 * 0.75 + 0.25 + 0.15 * 2 / 3, 1.0, 0.75, 0.6667)),
    (1, 5000, [], [], None, (0.30 / 3 + 0.25 * 0.5 + 0.15, 0.3333, 0.0, 1.0)),
    (9, 10000, [2.0], ["a"], None, (0.30 + 0.30 + 0.15, 1.0, 1.0, 1.0)),
    (9, 1, [1.0], ["a"], "boom", (0.0, 0.0, 0.0, 0.0)),
    (0, -5, None, None, "", (0.25 + 0.15, 0.0, 0.0, 1.0)),
])
def test_query_quality(spark, n, ms, rel, domains, error, want):
    df = spark.createDataFrame([(n, ms, rel, domains, error)], "n int, ms int, rel array<double>, d array<string>, e string")
    got = df.select(*evaluation.query_quality(F.col("n"), F.col("ms"), F.col("rel"), F.col("d"), F.col("e")).values()).first()
    assert tuple(got) == pytest.approx((round(want[0], 4), *want[1:]), abs=1e-4)


def test_related_categories(spark):
    pairs = [("food", "food"), ("food", "retail"), ("worship", "culture"), ("culture", "worship"), ("food", "bank"), (None, "food"), ("", "x"), ("office", "industrial")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(resolution.category_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6, 0.6, 0.1, 0.1, 0.4, 0.4, 0.6]


def test_spans_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(p, i, 10 + rng.random() * s, 106 + rng.random() * s) for p, s in enumerate((0.5, 0.01, 0.0001)) for i in range(60)] + [(9, 0, 1.0, 2.0), (9, 1, None, 2.0)]

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    got = {r.place_id: r.span_m for r in resolution._spans(spark.createDataFrame(rows, "place_id int, record_id int, lat double, lon double")).collect()}
    for p in range(3):
        mine = [r for r in rows if r[0] == p]
        assert got[p] == pytest.approx(max(metres(a, b) for a in mine for b in mine), rel=1e-9)
    assert 9 not in got
