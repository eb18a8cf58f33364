"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import SPACE, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Overlapping patterns that the flow takes, and sources in all; more are refused.
MOST_PATTERNS, MOST_SOURCES = 2_000, 1_000_000
#: Tables of a row a pattern are broadcast up to that many rows, else joined by a shuffle.
SMALL = 20_000
SEED = 11
LEVELS, FINE = 3, 256


def n_words(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D."""
    squeezed = F.regexp_replace(text, SPACE, " ")
    inner = F.trim(squeezed)
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "))) + 1).cast("long")


def water_filled(sizes: dict, weights: dict, total: float, most: int = MOST_REPEATS) -> dict:
    """Targets that share `total` by weight, none above `most` times its size; what that cuts off is
    shared again by weight among the others."""
    targets, open_, left = {}, set(sizes), total
    while open_:
        scale = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if scale * weights[s] >= most * sizes[s]}
        if not full:
            return targets | {s: scale * weights[s] for s in open_}
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ -= full
    return targets


def min_cost_flow(arcs: list[tuple[int, int, float, float]], nodes: int, source: int, sink: int) -> list[float]:
    """Successive shortest paths with potentials. arcs: (from, to, capacity, cost >= 0); returns the flow on each."""
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        for u, v, x, y in ((a, b, c, w), (b, a, 0.0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(x)
            cost.append(y)
    tiny = 1e-9 * max([c for *_, c, _ in arcs], default=1.0)
    height = [0.0] * nodes
    while True:
        far, via = [float("inf")] * nodes, [-1] * nodes
        far[source], heap = 0.0, [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e] > tiny and (new := d + cost[e] + height[u] - height[to[e]]) < far[to[e]] - 1e-12:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if far[sink] == float("inf"):
            return [c - cap[2 * i] for i, (*_, c, _) in enumerate(arcs)]
        height = [h + min(f, far[sink]) for h, f in zip(height, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(sizes: dict[tuple, int], targets: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """For each membership pattern (a tuple of sources), the tokens that it gives to each source. A
    pattern's r-th repetition has its size as capacity and costs r - 1, so text is repeated only when
    no fresh text is left; quotas are the targets."""
    patterns, sources = sorted(sizes, key=str), sorted(targets, key=str)
    at = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + i + 2 for i, s in enumerate(sources)}
    arcs = [(0, at["p", p], float(sizes[p]), float(r)) for p in patterns for r in range(most)]
    links = [(p, s) for p in patterns for s in p]
    arcs += [(at["p", p], at["s", s], float(most * sizes[p]), 0.0) for p, s in links]
    arcs += [(at["s", s], 1, float(targets[s]), 0.0) for s in sources]
    flow = min_cost_flow(arcs, len(at) + 2, 0, 1)[most * len(patterns) : most * len(patterns) + len(links)]
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), f in zip(links, flow, strict=True):
        out[p][s] = f
    return out


def planned(sizes: dict[tuple, int], targets: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """route() for the patterns of sources that overlap with others; a source whose documents have no other takes
    what it needs of its own, which is the same."""
    shared = {s for p in sizes if len(p) > 1 for s in p}
    alone = {p: {p[0]: min(float(most * n), targets[p[0]])} for p, n in sizes.items() if len(p) == 1 and p[0] not in shared}
    rest = {p: n for p, n in sizes.items() if p not in alone}
    return alone | (route(rest, {s: targets[s] for s in shared}, most) if rest else {})


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size and target of its (first) source,
    taken (words the mix takes, a whole number of times its size), repeats (that number), serves (map of each of
    its sources to the share of the taken words that counts for it) and text_hash.

    sources: an array column of the sources a document belongs to; by default its one `source`.
    Sources in code-point order, null last, weigh `weights`, repeating; targets see water_filled.
    1. Documents aggregate to patterns, the sets of their sources: one row a pattern reaches the driver; more than
    MOST_SOURCES patterns, or MOST_PATTERNS of several sources, are refused. 2. planned() sends their capacity
    to the quotas. 3. In a pattern with flow q times its size every document is taken floor(q) times, and the rest
    goes to documents in the order of a seeded hash of doc_id and text. Where the sum reaches the rest is found by
    LEVELS rounds of FINE hash bins, each within the bin before, and in the last bin row by row; documents that
    would pass the sum by over half are left. So no task puts more than FINE bins or a FINE ** LEVELS-th of a
    pattern in order.

    Null text has size 0 and is never taken. Null and repeated doc_id count as rows of their own, spread by their
    text; equal rows lie at one place of the order. Other columns are ignored. Reruns agree.
    """
    names = F.array(docs["source"].cast("string")) if sources is None else sources
    key = F.transform(F.array_sort(F.array_distinct(names)), lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("~")))
    body = text_of(docs)
    sized = docs.select(docs.doc_id.cast("long").alias("doc_id"), n_words(body).alias("size"), F.to_json(key).alias("pattern"), F.get(key, F.lit(0)).alias("first"), F.xxhash64(body, F.lit(seed)).alias("text_hash"))
    sized = written(sized.withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed))), "sized")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    named = {tuple(json.loads(r["pattern"])): r["pattern"] for r in found}  # as Spark writes it: escapes differ from json.dumps
    sizes = {tuple(json.loads(r["pattern"])): r["n"] for r in found}
    if len(found) > MOST_SOURCES or sum(len(p) > 1 for p in sizes) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_SOURCES} membership patterns, or {MOST_PATTERNS} of several sources")
    source_size: dict = {}
    for p, n in sizes.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    ordered = sorted(source_size, key=lambda s: (s == "~", s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    targets = water_filled(source_size, weight, float(sum(sizes.values())), most)
    flow = planned(sizes, targets, most)
    plan = []
    for p, n in sizes.items():
        took = sum(flow[p].values())
        whole = min(most, int((took + 1e-6 * max(n, 1)) // n)) if n else 0
        serves = {s[1:] if s != "~" else None: f / took for s, f in flow[p].items() if took and f}
        plan.append((named[p], whole, float(max(0.0, took - whole * n)) if whole < most else 0.0, json.dumps([[k, v] for k, v in serves.items()])))
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan, "pattern string, whole int, rest double, serves string")  # a row a pattern; the size decides how it is joined
    source_df = spark.createDataFrame([(s, int(n), float(targets[s])) for s, n in source_size.items()], "first string, source_size long, target double")

    small = F.broadcast if len(plan) <= SMALL else (lambda df: df)
    bits = FINE.bit_length() - 1
    bin_of = lambda level: F.expr(f"CAST(shiftrightunsigned(place, {64 - bits * (level + 1)}) & {FINE - 1} AS int)")
    known = sized.join(small(plan_df.drop("serves")), "pattern")
    open_, edges = known, plan_df.select("pattern", F.array().cast("array<int>").alias("edge"), F.lit(0).cast("double").alias("below"))
    for level in range(LEVELS):
        bins = open_.withColumn("bin", bin_of(level)).groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("n")).join(small(edges), "pattern")
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("pattern").orderBy("bin"))  # FINE bins a pattern
        reached = bins.withColumn("upto", upto).where("upto > rest and upto - n <= rest").groupBy("pattern").agg(F.min(F.struct("bin", F.expr("upto - n").alias("below"), "edge")).alias("e"))
        edges = written(reached.select("pattern", F.concat("e.edge", F.array("e.bin")).alias("edge"), F.col("e.below").alias("below")), "edges")
        open_ = known.join(small(edges.select("pattern", "edge")), "pattern").where(" and ".join(["true", *(f"shiftrightunsigned(place, {64 - bits * (k + 1)}) & {FINE - 1} = edge[{k}]" for k in range(level + 1))])).drop("edge")
    mine = F.array(*[bin_of(k) for k in range(LEVELS)])
    all_known = known.join(small(edges), "pattern", "left").withColumn("mine", mine)
    # rows of the edge bins alone are put in order
    last = all_known.where("mine = edge")
    order = Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("below") + F.sum("size").over(order))
    last = last.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    before = F.coalesce((F.col("mine") < F.col("edge")).cast("int"), (F.col("rest") > 0).cast("int"))
    rest = all_known.where("edge is null or mine <> edge").withColumn("extra", before)
    out = last.unionByName(rest).join(small(source_df), "first").join(small(plan_df.select("pattern", "serves")), "pattern")
    repeats = F.least(F.col("whole") + F.col("extra"), F.lit(most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"), F.when(F.col("size") > 0, repeats).otherwise(F.lit(0)).alias("repeats"), "serves", "text_hash")


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """docs with each row as many times as the mix takes it, columns unchanged. A decision belongs to a doc_id (null
    too) and text: rows that repeat both follow the largest."""
    taken = mix(docs, seed=seed, **options).where("repeats > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).agg(F.max("repeats").alias("__n"))
    mine = F.xxhash64(text_of(docs), F.lit(seed))
    joined = docs.withColumn("__t", mine).join(taken.hint("merge"), docs.doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[docs[c] for c in docs.columns])
