"""Recall and precision of the near stage beside all pairs of texts at 0.8: python -m tests.llm.measure_near [sf_dir]."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

from tessera.llm import simhash

from .test_simhash import shingles


def similar_pairs(sets: dict[int, frozenset]) -> set[tuple[int, int]]:
    """All pairs with 80 % of their shingles in common, by prefixes of the rarest shingles."""
    often = Counter(x for s in sets.values() for x in s)
    prefix, out = defaultdict(list), set()
    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]
        for j in {j for x in rare for j in prefix[x]}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                out.add((j, i))
        for x in rare:
            prefix[x].append(i)
    return out


def main(sf: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        if (s := frozenset(shingles(r.text))) not in first:
            first[s] = r.doc_id  # texts of one set are one
            sets[r.doc_id] = s
    want = similar_pairs(sets)
    met = {p for p in want if group[p[0]] == group[p[1]]}
    near = defaultdict(set)
    for i, j in want:
        near[i].add(j)
        near[j].add(i)
    own = {i: first[frozenset(shingles(t))] for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    gone = {i for i, g in group.items() if g != i}
    alone = [i for i in gone if own[i] == i and not near[i]]
    print(f"{len(sets)} different texts, {len(want)} pairs at 0.8, {len(met)} of them in one group: {len(met) / max(len(want), 1):.3f}")
    print(f"{len(gone)} rows go; {len(alone)} of them have no text at 0.8")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
