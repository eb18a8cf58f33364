import random

import pytest

from tessera.operators import greedy


def fold(items, least):
    """The rule read plainly: one item after the other."""
    out, founders = {}, {}
    for grp, pos, ident, sh in sorted(items, key=lambda r: (r[0], r[1])):
        sims = [(round(len(set(sh) & f) / min(len(set(sh)), len(f)), 12) if sh and f else 0.0, -p) for p, f in founders.get(grp, [])]
        best = max(sims, default=(0.0, 0))
        if best[0] >= least:
            out[grp, ident] = (-best[1], best[0])
        else:
            founders.setdefault(grp, []).append((pos, set(sh)))
            out[grp, ident] = (pos, 1.0)
    return out


def got(spark, items, least):
    df = spark.createDataFrame(items, "grp int, pos long, id string, sh array<long>").repartition(4)
    return {(r.grp, r.id): (r.founder, r.sim) for r in greedy.clusters(df, least).collect()}


def sources(seed, n, groups):
    """Families of overlapping sets, copies, sets within sets, a shingle that all have, empty ones."""
    rng = random.Random(seed)
    out, sets = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and sets:
            sh = list(rng.choice(sets))
        elif kind < 0.5 and sets:
            base = rng.choice(sets)
            sh = list({*rng.sample(sorted(base), max(1, len(base) // 2)), *(rng.randint(0, 400) for _ in range(rng.randint(0, 9)))}) if base else []
        elif kind < 0.53:
            sh = []
        else:
            sh = [rng.randint(0, 400) for _ in range(rng.randint(1, 14))]
        if sh and rng.random() < 0.7:
            sh.append(999)
        sets.append(set(sh))
        out.append((rng.randrange(groups), i, f"d{i}", sh))
    return out


@pytest.mark.parametrize("least,block,pairs", [(0.25, 64, 64), (0.5, 5, 0), (0.25, 3, 2)])
def test_rounds_give_what_a_fold_gives(spark, monkeypatch, least, block, pairs):
    monkeypatch.setattr(greedy, "BLOCK", block)
    monkeypatch.setattr(greedy, "PAIRS", pairs)
    items = sources(3, 260, 3)
    if pairs == 0:
        items = items[:120]
    want = fold(items, least)
    assert got(spark, items, least) == want and len({v[0] for v in want.values()}) > 10


def test_a_large_group_of_alike_sources(spark):
    """20,000 sources of one query that all resemble the first: no pairs of them are listed."""
    rows = spark.range(20_000).selectExpr("1 AS grp", "id AS pos", "CAST(id AS string) AS id", "array_distinct(concat(sequence(1L, 8L), array(100 + id % 7000, 9000 + id))) AS sh")
    out = greedy.clusters(rows, 0.5)
    assert out.select("founder").distinct().count() == 1 and out.count() == 20_000
    assert greedy.clusters(rows.where("false"), 0.5).count() == 0
