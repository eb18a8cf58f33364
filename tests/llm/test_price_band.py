import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import price_band
from tessera.llm.price_band import HELD, LISTED, Nearest, capped, combine

ITEMS = "item_id long, name string, price double"
LINES = "sale_id long, line_no int, item_id long, quantity int, amount double"


def cents(x):
    return None if x is None or not math.isfinite(x) or abs(x * 100 + 0.5) >= 2**53 else math.floor(100 * x + 0.5)


def brute(items, lines):
    """All pairs, read plainly."""
    priced = []
    for sale, line, item, q, amount in lines:
        a = cents(amount)
        if None not in (sale, item, q, a) and q != 0:
            priced.append(((2 * a + q) // (2 * q), sale, line, item, zlib.crc32(f"{sale},{'' if line is None else line},{item}".encode())))
    out = []
    for item, _, price in items:
        p = cents(price)
        pairs = [] if p is None or item is None else [(abs(u - p), u, sale, line, other, crc) for u, sale, line, other, crc in priced if other != item and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * min(u, p))]
        pairs.sort(key=lambda r: tuple(-math.inf if x is None else x for x in r[:5]))
        sums = (len(pairs), sum(r[0] for r in pairs), sum(r[5] for r in pairs))
        out += [(item, k + 1, *r[:5], *sums) for k, r in enumerate(pairs[:10])] or [(item, 0, *[None] * 5, 0, 0, 0)]
    return sorted(out, key=str)


def got(spark, items, lines, **how):
    df = price_band.near_prices(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES).repartition(5), **how)
    return sorted(map(tuple, df.collect()), key=str)


def shop(seed, n_items=60, n_lines=900, hot=0.0, spread=400.0):
    rng = random.Random(seed)
    price = lambda: rng.choice([rng.randint(1, 12) * 1.0, round(rng.uniform(0.5, spread), 2), 3.0])
    items = [(i, "n", price()) for i in range(n_items)]
    lines = []
    for k in range(n_lines):
        item = 0 if rng.random() < hot else rng.randrange(n_items + 5)
        q = rng.randint(1, 50)
        lines.append((k // 3, k % 3, item, q, round((items[item][2] if item < n_items else price()) * q * rng.choice([1, 0.95, 0.9]), 2)))
    return items, lines


@pytest.mark.parametrize("seed,hot,spread", [(1, 0, 400), (2, 0.4, 400), (3, 0.9, 8), (4, 0.1, 90_000)])
def test_near_prices_match_brute_force(spark, seed, hot, spread):
    items, lines = shop(seed, hot=hot, spread=spread)
    assert got(spark, items, lines) == brute(items, lines)


def test_many_ranges_carry_totals_and_neighbours(spark):
    """Ranges smaller than a band: an item's lines and its three events stand in different ones."""
    items, lines = shop(5, 40, 400, hot=0.3, spread=6)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert got(spark, items, lines) == brute(items, lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_awkward_rows(spark):
    items = [(1, "a", 5.0), (2, "b", None), (None, "c", 5.0), (3, "d", 5.0), (3, "d", 5.0), (3, "d", 9.0), (4, "e", 0.0), (5, "f", -1.0), (6, "g", math.nan), (7, "h", math.inf), (8, "i", 1e300), (9, "j", 1000.0), (10, "k", 0.005)]
    lines = [(1, 1, 1, 1, 5.0)] * 13 + [(2, None, 3, 2, 10.0), (2, 0, 3, 2, 10.0), (None, 1, 3, 1, 5.0), (3, 1, None, 1, 5.0), (3, 1, 9, None, 5.0), (3, 1, 9, 0, 5.0), (3, 1, 9, 1, None), (4, 1, 9, 1, math.nan), (4, 1, 9, -2, 10.0), (4, 2, 9, 3, -2.0), (5, 1, 9, 1, 1e300)]
    lines += [(6, k, 20, 1, 1000 + d) for k, d in enumerate([-5.0, -4.98, -4.97, 5.0, 5.01, -0.5, 0.5])]
    assert got(spark, items, lines) == brute(items, lines)


def test_empty_tables_and_clashing_columns(spark):
    items, lines = shop(6, 5, 30)
    assert got(spark, [], lines) == [] and got(spark, items, []) == brute(items, [])
    more = spark.createDataFrame([(*r, 1, 2, 3) for r in items], ITEMS + ", p long, u long, n long")
    wide = spark.createDataFrame([(*r, 1, 2, "x") for r in lines], LINES + ", p long, crc long, kind string")
    assert sorted(map(tuple, price_band.near_prices(more, wide).collect()), key=str) == brute(items, lines)


def test_combining_parts_is_combining_all():
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, 4, 3000), rng.integers(0, 500, 3000), rng.integers(0, 3, 3000), rng.integers(0, 6, 3000) ** 2 // 9, np.ones(3000, int), rng.integers(0, 99, 3000)])
    whole = combine(rows.copy())
    parts = combine(np.concatenate([combine(rows[:, k::7].copy()) for k in range(7)], axis=1))
    assert np.array_equal(whole, parts) and whole[4].sum() == 3000
    for u in range(4):
        lines = sorted(map(tuple, rows[:4, rows[0] == u].T.tolist()))
        assert list(map(tuple, whole[:4, whole[0] == u].T.tolist())) == capped(lines)


def test_heaps_hold_the_same_in_any_order():
    rng = random.Random(2)
    lines = [(rng.randint(90, 110), rng.randint(0, 50), 1, rng.choice([1, 1, 1, 2, 3])) for _ in range(300)]
    want = capped(sorted(lines, key=lambda r: (abs(r[0] - 100), r)))
    for _ in range(5):
        rng.shuffle(lines)
        heap = Nearest(100, lines)
        assert heap.lines() == want and len(want) == HELD
    of = defaultdict(int)
    for r in want:
        of[r[3]] += 1
    assert max(of.values()) <= LISTED
