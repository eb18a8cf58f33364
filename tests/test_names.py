import random
from functools import lru_cache

import pytest

from tessera import catalog
from tessera.operators.names import NameIndex

SCHEMA = "place_id long, name string, aliases array<string>"


@lru_cache(None)
def edits(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))


def brute(places, asked, half_typed=False, k=20):
    """place_id and relevance by comparing every word with every word. Names here are plain lower-case words."""
    out = []
    for place, name, aliases in places:
        words = {w for n in [name, *(aliases or [])] if n for w in n.split()}
        worths = []
        tokens = list(dict.fromkeys(asked.split()))
        for at, t in enumerate(tokens):
            most = 0 if len(t) < 3 else 1 if len(t) < 6 else 2
            worth = [1.0 if w == t else 0.5 for w in words if w == t or w[0] == t[0] and edits(t, w) <= most]
            worth += [0.8 for w in words if half_typed and at == len(tokens) - 1 and w.startswith(t) and w != t]
            worths.append(max(worth, default=0))
        if worths and all(worths):
            out.append((place, round(sum(worths) / len(worths), 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def lookup(spark, index, *asked, **how):
    got = index.lookup(spark.createDataFrame(list(enumerate(asked)), "query_id int, q string"), **how).collect()
    return {i: [(r.place_id, r.relevance) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] for i in range(len(asked))}


def test_one_place_for_every_spelling(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "n"), 4)
    index.rebuild(spark.createDataFrame([(1, "Phở Thìn", ["Lò Đúc"]), (2, "Bún chả", None), (3, None, None)], SCHEMA))
    got = lookup(spark, index, "phở", "pho", "phoo", "thin pho", "phở chả", "duc", "xyz", "", "pho thi", half_typed=True)
    assert [[p for p, _ in got[i]] for i in range(9)] == [[1], [1], [1], [1], [], [1], [], [], [1]]


def test_lookup_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcd", k=rng.randint(1, 11))) for _ in range(120)]
    places = [(i, " ".join(rng.sample(vocab, rng.randint(1, 4))), [rng.choice(vocab)] if i % 5 == 0 else None) for i in range(200)]
    index = NameIndex(spark, str(tmp_path / "n"), 8)
    index.rebuild(spark.createDataFrame(places, SCHEMA))
    asked = []
    for _ in range(60):
        words = rng.sample(rng.choice(places)[1].split(), 1)
        w = list(words[0])
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w)) if w else 0
            w[at : at + 1] = rng.choice([[], [rng.choice("abcd")], [rng.choice("abcd"), *w[at : at + 1]]])
        asked.append(" ".join(["".join(w) or "a", *rng.sample(vocab, rng.randint(0, 1))]))
    for half in (False, True):
        assert lookup(spark, index, *asked, half_typed=half) == {i: brute(places, q, half) for i, q in enumerate(asked)}


def test_a_rebuild_replaces_all(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "n"), 4)
    assert lookup(spark, index, "one") == {0: []}
    index.rebuild(spark.createDataFrame([(1, "one", None)], SCHEMA))
    index.rebuild(spark.createDataFrame([(2, "two", None)], SCHEMA))
    assert lookup(spark, NameIndex(spark, str(tmp_path / "n"), 4), "one", "two") == {0: [], 1: [(2, 1.0)]}


def test_a_frequent_word_brings_no_candidates(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "n"), 4)
    rare = ["".join("bcdfghjklm"[int(c)] for c in f"{i * 7919 % 100000:05d}") * 2 for i in range(300)]
    index.rebuild(spark.createDataFrame([(i, f"common {w}", None) for i, w in enumerate(rare)], SCHEMA))
    asked = spark.createDataFrame([(i, f"common {w}") for i, w in enumerate(rare[:50] * 2)], "query_id int, q string")
    means = index.meanings(asked)
    assert means.where("token = 'common'").count() == 100
    assert index.candidates(means).count() < 300  # not 100 queries times 300 places
    assert {i: r[0] for i, r in lookup(spark, index, *(f"common {w}" for w in rare[:50] * 2)).items()} == {i: (i % 50, 1.0) for i in range(100)}


@pytest.mark.parametrize("name", ["name_lookup", "name_completions"])
def test_every_client_is_asked(spark, sf_dir, name):
    got = {r.query_id for r in catalog.queries()[name](spark, sf_dir).select("query_id").distinct().collect()}
    assert any(i % 5 for i in got)
