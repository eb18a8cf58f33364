import numpy as np
import pytest

from tessera.operators import retrieval
from tessera.operators import vectors as vectors_module
from tessera.operators.retrieval import knn_topk
from tessera.operators.vectors import VectorIndex

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], SCHEMA).repartition(4)


def nearest(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.doc)
    return out


def recall(got, want):
    return np.mean([len(got.get(q, set()) & d) / len(d) for q, d in want.items()])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    return np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.25 * rng.normal(size=(3000, 32))


def test_a_tenth_of_the_rows_gives_nine_tenths_of_the_neighbours(spark, clustered, tmp_path):
    vectors = table(spark, clustered)
    queries = vectors.where("vec_id % 20 = 0")
    want = nearest(knn_topk(vectors, queries, 10))
    index = VectorIndex(spark, str(tmp_path / "v"))
    state = index.rebuild(vectors, cells=60, fit_rows=2000)
    assert state["probes"] * max(state["sizes"].values()) < 300 and sum(state["sizes"].values()) == 3000
    assert recall(nearest(index.search(queries, 10)), want) >= 0.9
    exact = index.search(queries, 10, probes=60, refine=300)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, knn_topk(vectors, queries, 10).collect()))


def test_vectors_without_clusters_are_found_by_their_codes(spark, tmp_path):
    """Every cell is probed, its codes read, and a twentieth of the rows compared in full."""
    x = np.random.default_rng(2).normal(size=(2000, 64))
    vectors = table(spark, x)
    queries = vectors.where("vec_id % 20 = 0")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.rebuild(vectors)
    got = index.search(queries, 10, refine=10)
    assert recall(nearest(got), nearest(knn_topk(vectors, queries, 10))) >= 0.9 and 10 * 10 <= 0.05 * 2000


def test_awkward_vectors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        index.rebuild(table(spark, np.zeros((3, 4))))
    rows = table(spark, np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0]]), [1, 2, 3, 4]).union(spark.createDataFrame([(5, None), (None, [1.0, 0.0, 0.0])], SCHEMA))
    assert index.rebuild(rows)["rows"] == 3
    got = [(r.query_id, r.doc, r.score, r["rank"]) for r in index.search(rows.where("vec_id in (1, 4, 5)"), 5).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(1, 2, 1.0, 1), (1, 3, 0.0, 2)] and {r[0] for r in got} <= {1, 4}
    assert index.search(rows.where("false")).count() == 0


def test_slices_and_short_lists_of_any_size_give_the_same(spark, clustered, tmp_path, monkeypatch):
    vectors = table(spark, clustered[:1000])
    queries = vectors.where("vec_id % 20 = 0")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.rebuild(vectors, cells=20, fit_rows=1000)
    rows = lambda df: sorted(map(tuple, df.collect()))
    exact, near = rows(knn_topk(vectors, queries, 10)), rows(index.search(queries, 10, probes=20))
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 3)
    assert rows(knn_topk(vectors, queries, 10)) == exact and len(exact) == 500
    for listed in (200, 5000):  # all is handed on at once; the best are kept
        monkeypatch.setattr(vectors_module, "LISTED", listed)
        assert rows(index.search(queries, 10, probes=20)) == near and len(near) == 500
