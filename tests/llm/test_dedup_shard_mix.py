import json
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.sharding import shard_documents

from .fixtures import awkward, frame, words


def brute_exact(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    ids = defaultdict(list)
    for i, t in enumerate(norm):
        ids[t].append(i)
    return {i: (ids[t][0], len(ids[t]), i == ids[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


def test_exact_matches_brute_force(spark):
    texts = awkward(6) + ["same\tsame"] * 30 + ["same same"] * 5
    got = {r[0]: tuple(r)[1:] for r in exact_groups(frame(spark, texts)).collect()}
    assert got == brute_exact(texts)


def test_colliding_digests_don_t_merge(spark):
    texts = awkward(7) + ["q q"] * 9
    weak = exact_groups(frame(spark, texts), digest=lambda t: F.pmod(F.length(t), F.lit(4)).cast("string"))
    assert {r[0]: tuple(r)[1:4] for r in weak.collect()} == {i: v[:3] for i, v in brute_exact(texts).items()}


def test_shards_are_even_and_slots_gapless(spark):
    texts = awkward(8, 300)[:-2] + ["hot text of some length " * 4] * 150
    rows = shard_documents(frame(spark, texts), 7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 7
    assert shard_documents(frame(spark, ["a"]).where("false")).count() == 0
    assert [r.slot for r in shard_documents(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string"), 1).orderBy("slot").collect()] == [0, 1, 2]


def test_water_filling_and_flow():
    sizes = {"a": 10, "b": 100, "c": 1000}
    t = mixing.water_filled(sizes, {"a": 5, "b": 2, "c": 1}, 1110)
    assert t["a"] == 30 and t["b"] == 300 and abs(sum(t.values()) - 1110) < 1e-6
    got = mixing.route({("a",): 10, ("a", "b"): 30, ("b",): 20}, {"a": 25.0, "b": 35.0})
    assert sum(f.get("a", 0) for f in got.values()) == pytest.approx(25) and sum(f.get("b", 0) for f in got.values()) == pytest.approx(35)
    assert sum(got[("a", "b")].values()) == pytest.approx(30)  # all fresh text before any repetition


def test_mix_meets_targets(spark):
    texts = [("w " * (5 + i % 40)) for i in range(600)] + [None, "", " "]
    docs = frame(spark, texts).withColumn("source", F.expr("case when doc_id % 10 = 0 then 'a' when doc_id % 10 < 4 then 'b' when doc_id % 97 = 5 then null else 'c' end"))
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == len(words(texts[r.doc_id])) and r.taken <= 3 * r["size"]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    total = sum(size.values())
    want = mixing.water_filled(size, {"a": 5, "b": 2, "c": 1, None: 5}, total)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 45
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed_documents(docs.withColumn("whole", F.lit(1)))
    assert out.columns == [*docs.columns, "whole"] and out.count() == sum(r.repeats for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mix_keeps_sources_with_control_characters(spark):
    names = ["a", "b\x0b", "\x1a\x1f", 'q"\\/', "é\x0e", "\x7f\x01\n\t"]
    docs = spark.createDataFrame([(i, "w " * 9, s) for i, s in enumerate(names * 3)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == list(range(18))


def test_hot_texts_stay_whole_while_a_shard_has_room(spark):
    texts = [f"row {i} " + "x" * (i % 50) for i in range(4000)] + ["a hot text " * 3] * 90 + ["another hot text " * 3] * 60
    rows = shard_documents(frame(spark, texts), 8).collect()
    of = defaultdict(set)
    load = Counter()
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
    assert max(map(len, of.values())) == 1 and max(load.values()) < 1.01 * min(load.values())


def test_shards_with_clashing_columns_and_awkward_ids(spark):
    docs = frame(spark, ["a", "b", None]).selectExpr("CAST(NULL AS long) AS doc_id", "text", "1 AS shard", "2 AS size", "3 AS key", "4 AS cell")
    rows = shard_documents(docs.union(docs), 2).collect()
    assert len(rows) == 6 and {r.law for r in rows} == {"bytes"}


def brute_flow(sizes, targets, most):
    """The most tokens that can be routed, and the least cost of that many, over whole tokens."""
    patterns = list(sizes)
    choices = [[(r, split) for r in range(most * sizes[p] + 1) for split in _splits(r, len(p))] for p in patterns]
    best = (0, 0)

    def go(i, used, total, cost):
        nonlocal best
        if i == len(patterns):
            best = max(best, (total, -cost))
            return
        n = sizes[patterns[i]]
        for r, split in choices[i]:
            now = dict(used)
            for s, k in zip(patterns[i], split):
                now[s] = now.get(s, 0) + k
            if all(now[s] <= targets[s] for s in now):
                go(i + 1, now, total + r, cost + sum(min(max(r - c * n, 0), n) * c for c in range(most)))

    go(0, {}, 0, 0)
    return best[0], -best[1]


def _splits(r, n):
    return [(r,)] if n == 1 else [(k, *rest) for k in range(r + 1) for rest in _splits(r - k, n - 1)]


@pytest.mark.parametrize("sizes,targets", [
    ({("a",): 2, ("a", "b"): 3, ("b",): 1}, {"a": 5, "b": 6}),
    ({("a", "b"): 4, ("b", "c"): 2}, {"a": 3, "b": 2, "c": 7}),
    ({("a",): 1, ("a", "b", "c"): 2, ("c",): 2}, {"a": 4, "b": 1, "c": 5}),
    ({("a",): 3, ("b",): 2}, {"a": 9, "b": 1}),
])
def test_flow_equals_brute_force(sizes, targets):
    got = mixing.planned(sizes, {s: float(t) for s, t in targets.items()})
    total = sum(sum(f.values()) for f in got.values())
    cost = sum(min(max(sum(f.values()) - c * sizes[p], 0), sizes[p]) * c for p, f in got.items() for c in range(3))
    assert (total, cost) == pytest.approx(brute_flow(sizes, targets, 3))
    for s, t in targets.items():
        assert sum(f.get(s, 0) for f in got.values()) <= t + 1e-6


def test_overlapping_sources_and_null_ids(spark):
    docs = spark.createDataFrame([(i, "w " * (5 + i % 11), "x") for i in range(900)], "doc_id long, text string, source string")
    of = F.expr("CASE doc_id % 5 WHEN 0 THEN array('a') WHEN 1 THEN array('a', 'b') WHEN 2 THEN array('b') WHEN 3 THEN array('c', NULL) ELSE array('c') END")
    rows = {r.doc_id: r for r in mixing.mix(docs, sources=of).collect()}
    members = {0: ["a"], 1: ["a", "b"], 2: ["b"], 3: ["c", None], 4: ["c"]}
    size, got = Counter(), Counter()
    for i, r in rows.items():
        for s in members[i % 5]:
            size[s] += r["size"]
        for s, share in json.loads(r.serves):
            got[s] += share * r.taken
    total = sum(r["size"] for r in rows.values())
    targets = mixing.water_filled(size, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}, float(total))
    patterns = Counter()
    for i, r in rows.items():
        patterns[tuple(members[i % 5])] += r["size"]
    flow = Counter()
    for split in mixing.planned(patterns, targets).values():
        flow.update(split)
    assert all(abs(got[s] - flow[s]) <= 60 for s in size)
    nulls = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "concat('s', length(text) % 3) AS source", "'q' AS target", "1 AS serves")
    twice = nulls.union(nulls)
    assert mixing.mix(twice).count() == 1800 and mixing.mixed_documents(twice).count() > 0


def test_exact_groups_of_awkward_tables(spark):
    docs = frame(spark, ["a  b", "a b", None, ""])
    assert exact_groups(docs.where("false")).count() == 0
    odd = docs.selectExpr("CASE WHEN doc_id < 3 THEN doc_id END AS doc_id", "text", "1 AS digest", "2 AS salt", "3 AS body", "4 AS n", "5 AS hot")
    rows = sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd.union(odd)).collect())))
    want = [(0, 0, 4, True), (1, 0, 4, False), (2, 2, 4, True), (None, 2, 4, False)] * 2
    assert rows == sorted(map(str, want))
