import random

import pytest

from tessera.operators.inverted import InvertedIndex
from tessera.operators.retrieval import bm25_topk

VOCAB = [f"w{i}" for i in range(300)]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(VOCAB, [1 / (k + 1) for k in range(300)], k=rng.choice([0, 3, 20, 60, 200])))) for i in range(n)]
    return rows + [(n, None), (n + 1, "the of"), (n + 2, "only w299 here")]


QUERIES = [(1, "w3 w17 w250"), (2, "w0 w1 the"), (3, "nothing known"), (4, "w299"), (5, ""), (6, "w5 w5 w40 W41"), (7, " ".join(VOCAB[40:80]))]


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(corpus(1, 1500), "doc_id long, text string").repartition(4), spark.createDataFrame(QUERIES, "query_id long, query string")


def test_search_equals_a_full_scan_and_opens_fewer_spans(spark, tables, tmp_path):
    docs, queries = tables
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=16, span_docs=32)
    index.add(docs)
    for k, probes in ((5, 2), (60, 4), (5000, 1)):
        assert ranked(index.search(queries, k, probes=probes)) == ranked(bm25_topk(docs, queries, k))
    rows = index.chosen(queries, 5)[0].where("query_id in (4, 7)").groupBy("query_id", "kept").count().collect()
    opened = {(r.query_id, r.kept): r["count"] for r in rows}
    assert opened[7, True] < opened[7, True] + opened.get((7, False), 0)


def test_new_documents_are_added_alone(spark, tables, tmp_path):
    docs, queries = tables
    at = tmp_path / "i"
    index = InvertedIndex(spark, str(at), buckets=8, span_docs=64)
    index.add(docs.where("doc_id % 3 = 0"))
    before = {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    index.add(docs.where("doc_id % 3 = 1"))
    index.add(docs.where("doc_id % 3 = 2"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert ranked(index.search(queries, 20)) == ranked(bm25_topk(docs, queries, 20))
    with pytest.raises(ValueError, match="already"):
        index.add(docs.where("doc_id = 7"))
    index.compact()
    assert len(index.segments()) == 1 and ranked(InvertedIndex(spark, str(at)).search(queries, 20)) == ranked(bm25_topk(docs, queries, 20))


def test_a_search_reads_the_folders_of_its_terms(spark, tables, tmp_path):
    docs, _ = tables
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(docs)
    one = index.of_terms(spark.createDataFrame([("w250",)], "term string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and one.select("bucket").distinct().count() == 1
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    bucket = one.first().bucket
    blocks = tmp_path / "i" / "s1" / "blocks"
    assert size(blocks / f"bucket={bucket}") < size(blocks) / 8


def test_no_documents_and_no_terms(spark, tmp_path):
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = InvertedIndex(spark, str(tmp_path / "i"))
    assert index.search(queries).count() == 0
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(queries).count() == 0
    index.add(spark.createDataFrame([(1, None), (None, "w1"), (2, "w4")], "doc_id long, text string"))
    assert [r.doc for r in index.search(spark.createDataFrame([(1, "w4 w1")], "query_id long, query string")).collect()] == [2]
