import math
from collections import Counter

import pytest

from tessera.operators import lexical
from tessera.operators.inverted import InvertedIndex
from tessera.operators.retrieval import bm25_topk

DOCS = [(i, " ".join(f"w{j}" for j in range(1, 40) if (i * 7 + j * j) % (j + 1) == 0) + " w1" * (i % 5)) for i in range(300)]
QUERIES = [(q, f"w{q} w{q + 3} w{q * 2} w1") for q in range(1, 20)]


def plain(k):
    docs = {i: t.split() for i, t in DOCS}
    df = Counter(w for t in docs.values() for w in set(t))
    mean = sum(map(len, docs.values())) / len(docs)
    gain = lambda w, t: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    out = []
    for q, x in QUERIES:
        scored = [(-round(sum(gain(w, t) for w in set(x.split())), 9), i) for i, t in docs.items() if set(x.split()) & set(t)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("sizes", [(256, 256, 4096), (16, 4, 3)])
def test_spans_slices_and_products_of_any_size_rank_alike(spark, monkeypatch, tmp_path, sizes):
    for name, n in zip(("CHUNK_DOCS", "SLICE_QUERIES", "PRODUCT_TERMS"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, n)
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(QUERIES, "query_id long, query string")
    index = InvertedIndex(spark, str(tmp_path / "i"), span_docs=20)
    index.add(docs)
    for found in (bm25_topk(docs, queries, 12), index.search(queries, 12)):
        rows = sorted((r.query_id, r["rank"], r.doc, r.score) for r in found.collect())
        assert [r[:3] for r in rows] == [r[:3] for r in plain(12)]
        assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(rows, plain(12), strict=True))


def test_words_are_counted_without_an_exchange(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (None, ["a"])], "doc long, terms array<string>")
    for made in (lexical.counted(rows), lexical.chunk_blocks(rows)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc or 0, r.length, sorted(zip(r.terms, r.tfs, strict=True))) for r in lexical.counted(rows).collect()) == [(0, 1, [("a", 1)]), (1, 3, [("a", 1), ("b", 2)]), (2, 0, [])]


def test_rows_of_a_repeated_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "w1 w2"), (1, "w1"), (2, "w3"), (3, None)], "doc_id long, text string")
    found = bm25_topk(docs, spark.createDataFrame([(1, "w1")], "query_id long, query string")).collect()
    assert [(r.doc, r["rank"]) for r in found] == [(1, 1)]
