from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import rerank


def test_no_passage_is_sorted_for_the_mean_length(spark):
    words = "alpha beta gamma delta river stone".split()
    rows = [(q, s, p, "alpha river stone", " ".join(words[(s + p + k) % 6] for k in range(2 + (s * p) % 9))) for q in (1, 2) for s in range(6) for p in range(4)]
    p = spark.createDataFrame(rows, "query_id int, source_id int, pos int, query string, text string")
    got = rerank.reranked_passages(p, 5, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [avg" not in plan and "Window [row_number" in plan
    top = got.collect()
    assert sorted((r.query_id, r["rank"]) for r in top) == [(q, n) for q in (1, 2) for n in range(1, 6)]
    known = p.selectExpr("*", "split(text, ' ') AS tokens").selectExpr("*", "size(tokens) AS n_tokens")
    same = lambda rows: sorted((r.query_id, r.source_id, r.pos, r.score) for r in rows)
    assert same(rerank.reranked_passages(known, 5, 3).collect()) == same(top)


def test_scores_in_the_tasks_equal_the_formula(spark):
    """The columns' formula, which took apart the query anew for each passage, and a plan without it."""
    words = "alpha beta gamma river stone the river stone alpha".split()
    rows = [(q, s, 0, query, body) for q, query in enumerate(["Alpha river stone river", "the", "", None, "river stone alpha beta gamma river stone"]) for s, body in enumerate([" ".join(words[k:] + words[:k]).title() for k in range(5)] + ["", None, "nothing"])]
    p = spark.createDataFrame(rows, "query_id int, source_id int, pos int, query string, text string")
    full = p.withColumns({"q": text.tokenize(F.col("query")), "d": text.tokenize(F.col("text"))})
    full = full.join(full.groupBy("query_id").agg(F.avg(F.size("d")).alias("m")), "query_id")
    c = F.col
    score = F.round(0.5 * text.overlap(c("q"), c("d")) + 0.3 * F.least(rerank.bm25_local(c("q"), c("d"), c("m")) / 3, F.lit(1.0)) + 0.2 * text.phrase_bonus(c("query"), c("text")), 9)
    want = {(r.query_id, r.source_id): r.s for r in full.select("query_id", "source_id", score.alias("s")).collect()}
    got = rerank.reranked_passages(p, 100, 100)
    assert {(r.query_id, r.source_id): r.score for r in got.collect()} == want
    assert len(set(want.values())) >= 3
    assert "array_remove" not in got._jdf.queryExecution().optimizedPlan().toString()
