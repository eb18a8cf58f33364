import pytest

from tessera.operators import evidence
from tessera.operators.gateway import Gateway, Tools


def test_roles_retries_and_the_breaker():
    now, calls = [0.0], []

    def flaky(messages):
        calls.append("flaky")
        raise OSError

    g = Gateway({"default": lambda m: "plain", "planner": flaky, "json": lambda m: '```json\n{"a": 1}\n```'}, clock=lambda: now[0], wait=lambda s: None)
    assert g.complete([], "planner") == "plain" and calls == ["flaky"] * 2
    assert g.complete([], "planner") == "plain" and len(calls) == 3  # the third failure opens the breaker
    assert g.complete([], "planner") == "plain" and len(calls) == 3 and g.errors["planner"] == 3
    now[0] = 31.0
    g.complete([], "planner")
    assert len(calls) == 4  # half open: one trial, which fails
    assert g.complete([], "other") == "plain" and g.complete_json([], "json") == {"a": 1} and g.complete_json([]) is None
    assert Gateway({}).complete([]) is None


def test_tools(spark):
    t = Tools()

    def numbers(n=3):
        """The first n numbers.

        More."""
        return spark.range(int(n))

    t.add("numbers", numbers, "n")
    assert t.listed() == [{"name": "numbers", "arguments": ["n"], "description": "The first n numbers."}]
    assert t.call("numbers", n=2) == {"rows": [{"id": 0}, {"id": 1}], "more": False} and t.call("numbers", most=1)["more"]
    assert "error" in t.call("nope") and "error" in t.call("numbers", x=1)


@pytest.mark.parametrize("model,want", [
    (None, [("contradiction", 1.0), ("entailment", 1.0), ("neutral", 0.0)]),
    (lambda a, b: None, [("contradiction", 1.0), ("entailment", 1.0), ("neutral", 0.0)]),
    (lambda a, b: [("neutral", 0.5)] * len(a), [("neutral", 0.5)] * 3),
])
def test_labels_of_pairs(spark, model, want):
    claims = spark.createDataFrame([("k", "bridge opened 1990")], "key string, claim string")
    rows = spark.createDataFrame([("k", "The bridge never opened in 1990."), ("k", "In 1990 the bridge opened."), ("k", "Cats."), ("k", ""), ("z", "x")], "key string, text string")
    got = {r.evidence: (r.label, r.score) for r in evidence.nli_labels(claims, rows, model).collect()}
    assert [got[e] for e in ("The bridge never opened in 1990.", "In 1990 the bridge opened.", "Cats.")] == want and len(got) == 3
