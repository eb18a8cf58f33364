from collections import Counter

import pytest

from tessera.operators import greedy


@pytest.mark.parametrize("bucket", [2_000_000, 7])
def test_only_shingles_of_two_items_leave_the_tasks(spark, monkeypatch, bucket):
    monkeypatch.setattr(greedy, "BUCKET", bucket)
    items = [(g, p, [p * 10 + g, p * 10 + 1, 5, -(p % 3)]) for g in (97, 98) for p in range(9)] + [(99, 0, [])]
    items = [(str(g), p, sorted(set(sh))) for g, p, sh in items]
    df = spark.createDataFrame(items, "grp string, pos long, sh array<long>")
    count = Counter((g, s) for g, _, sh in items for s in sh)
    want = sorted((g, p, len(sh), s) for g, p, sh in items for s in sh if count[g, s] > 1)
    assert sorted(tuple(r) for r in greedy.shared_rows(df).collect()) == want
