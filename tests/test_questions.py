from tessera.functions import spans
from tessera.operators import research
from tessera.plans.understanding import _asked


def test_questions_are_spread_over_tasks(spark, sf_dir):
    assert _asked(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_variants_are_computed_once_a_row(spark):
    df = spark.createDataFrame([(1, "compare docker vs podman"), (2, None), (3, " A  a "), (4, "")], "query_id long, query string")
    got = research.planned_queries(df, 5, 2024)
    rows = [(r.query_id, r.asked) for r in got.orderBy("query_id", "sub").collect()]
    assert [a for i, a in rows if i == 1] == ["compare docker vs podman", "docker", "podman"] and {i for i, _ in rows} == {1, 3}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("và|and|between") <= 2


def test_fixed_forms_are_folded_once(monkeypatch):
    spans.local_parts("quán phở gần Huế")
    calls, fold = [], spans._fold
    monkeypatch.setattr(spans, "_fold", lambda s: calls.append(s) or fold(s))
    assert spans.local_parts("quán phở gần Huế")["locality"] == "Huế" and len(calls) < 12


def test_only_names_that_stand_in_the_text_are_searched():
    class Never:
        def finditer(self, text):
            raise AssertionError("searched")

    assert spans.entity_ids("Hà Nội", [("da nang", "x", Never()), *spans.compiled({"hn": "Hà Nội"})]) == ["hn"]
