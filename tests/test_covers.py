import math
import random

import numpy as np

from tessera.operators import covers, serving


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(rng, x, y, reach, n, least=0.2):
    """A ring around a point, of n points at random distances: concave, not closed."""
    return [(x + reach * rng.uniform(least, 1) * math.cos(2 * math.pi * k / n), y + reach * rng.uniform(least, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def brute(x, y, rings):
    odd = False
    for r in rings:
        for k in range(len(r)):
            (ax, ay), (bx, by) = r[k], r[k - 1]
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_a_thousand_polygons_match_brute_force(spark):
    rng = random.Random(6)
    shapes = []
    for i in range(1000):
        x, y, reach = rng.uniform(-179, 179), rng.uniform(-80, 80), 10 ** rng.uniform(-3, 1)
        rings = [star(rng, x, y, reach, rng.randint(3, 40))]
        if i % 3 == 0:
            rings.append(star(rng, x, y, reach * 0.15, rng.randint(3, 9)))  # a hole
        if i % 7 == 0:
            rings = [[(round(a), round(b)) for a, b in r] for r in rings]  # edges on cell borders, points that coincide
        shapes.append(rings)
    points = []
    for i, rings in enumerate(shapes):
        for _ in range(4):
            x, y = rng.choice(rings[0])
            points.append((x + rng.gauss(0, 0.3) * abs(x - rings[0][0][0]) + rng.choice([0, 1e-9]), y + rng.gauss(0, 0.3) * abs(y - rings[0][0][1])))
        points.append((np.mean([p[0] for p in rings[0]]), np.mean([p[1] for p in rings[0]])))
    points += [(float(a), float(b)) for a in range(-3, 4) for b in range(-3, 4)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "id int, lon double, lat double")
    s = spark.createDataFrame([(i, [ring(r) for r in rings]) for i, rings in enumerate(shapes)], "unit int, rings array<array<struct<x:double,y:double>>>")
    got = [(r.id, r.unit) for r in serving.in_polygons(p, s).collect()]
    xs, ys = np.array(points).T
    want = set()
    for i, rings in enumerate(shapes):
        e = covers.edges_of([ring(r) for r in rings])
        near = np.flatnonzero((xs >= e[:, [0, 2]].min()) & (xs <= e[:, [0, 2]].max()) & (ys >= e[:, [1, 3]].min()) & (ys <= e[:, [1, 3]].max()))
        want |= {(int(k), i) for k in near if brute(xs[k], ys[k], rings)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1500


def test_inner_cells_hold_most_of_a_large_shape():
    """A finely drawn circle: nine tenths of its area lie in cells without an edge, and a border cell has a small part of the edges."""
    circle = [(100 + 3 * math.cos(t), 20 + 3 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 4000, endpoint=False)]
    cells = list(covers.cells_of(covers.edges_of([ring(circle)])))
    area = lambda keep: sum(covers.size_of(c[0]) ** 2 for c in cells if c[3] == keep)
    assert area(True) > 0.9 * math.pi * 9 > 0.9 * area(True) and max(len(c[4]) for c in cells) < 400
    assert len({c[:3] for c in cells}) == len(cells) < 1500


def test_shapes_without_points(spark):
    s = spark.createDataFrame([("a", None), ("b", []), ("c", ring([(1, 1)])), ("d", ring([(0, 0), (2, 0)]))], "unit string, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 0.0)], "id int, lon double, lat double")
    assert serving.in_polygons(p, s).count() == 0 and serving.in_polygons(p, s.where("false")).count() == 0
