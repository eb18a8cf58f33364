import random

from tessera.operators import graph


def pairs(df):
    return {tuple(r) for r in df.collect()}


def brute(edges):
    out = {}
    nodes = {x for e in edges for x in e}
    for s in nodes:
        front, d, seen = {s}, 0, {}
        while front:
            d += 1
            front = {b for a, b in edges if a in front and a != b} - set(seen) - {s}
            seen |= dict.fromkeys(front, d)
        out |= {(s, k): v for k, v in seen.items()}
    return {(a, b, d) for (a, b), d in out.items()}


def test_closure_matches_brute_force(spark):
    rng = random.Random(2)
    for n, m in ((6, 5), (25, 40), (40, 41)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        df = spark.createDataFrame(sorted(edges), "key int, parent int")
        assert pairs(graph.closure(df)) == brute(edges)


def test_a_chain_of_any_length(spark):
    units = spark.createDataFrame([(i, i + 1 if i < 100 else None) for i in range(101)], "key int, parent_key int")
    got = pairs(graph.ancestors(units).where("key = 0"))
    assert got == {(0, k, k) for k in range(1, 101)} and graph.cycles(units).count() == 0
    moves = units.where("parent_key is not null").selectExpr("key AS from_key", "parent_key AS to_key")
    status = units.selectExpr("key", "CASE WHEN key = 100 THEN 'current' ELSE 'merged' END AS status")
    assert pairs(graph.current_successors(status, moves)) == {(k, 100) for k in range(101)}


def test_cycles_are_reported_and_branches_followed(spark):
    units = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None)], "key int, parent_key int")
    assert pairs(graph.cycles(units)) == {(1,), (2,), (3,), (5,)}
    assert pairs(graph.ancestors(units).where("key = 4")) == {(4, 1, 1), (4, 2, 2), (4, 3, 3)}
    status = spark.createDataFrame([(k, "current" if k in (7, 8) else "merged") for k in range(1, 11)] + [(11, None)], "key int, status string")
    moves = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 7), (4, 5), (5, 8), (5, 1), (6, 99), (8, 7), (9, 9), (11, 4)], "from_key int, to_key int")
    done, stuck = graph.walked(status, moves)
    assert pairs(done) == {(7, 7), (8, 8), (4, 7), (4, 8), (5, 8), (11, 7), (11, 8)}
    assert pairs(stuck) == {(1,), (2,), (3,), (4,), (5,), (9,), (11,)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "key int, parent_key int")
    assert graph.ancestors(none).count() == 0 and graph.cycles(none).count() == 0
    done, stuck = graph.walked(spark.createDataFrame([], "key int, status string"), spark.createDataFrame([], "from_key int, to_key int"))
    assert done.count() == 0 and stuck.count() == 0
