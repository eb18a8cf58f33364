import itertools
from collections import Counter, defaultdict

import pytest

from tessera.llm import filter_audit

from .fixtures import SCHEMA, awkward, words

MARKS = "step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute_fails(rows):
    """Which filters each row fails, by the rules read plainly."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, *_ in rows:
        t, w = text or "", words(text)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i)
        out.append("".join(k for k, f in zip("ABCDE", fails) if f))
    return out


def brute_audit(rows, labels):
    """Every order walked row by row."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    parts, out = defaultdict(list), {}
    for row, fails in zip(rows, brute_fails(rows)):
        parts[row[3] or ""].append((row[0], fails))
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == f for _, x in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in MARKS[1:]] for r in df.collect()}


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, 1) for i, t in enumerate(texts)]


TEXTS = awkward(3) + [" ".join(f"w{k % m}" for k in range(n)) for n in (199, 200, 201, 400) for m in (40, 99, 100, 101, 400)] + ["A" * n + "b" * (100 - n) for n in (1, 2, 3)] + ["x " * 300 + c for c in "#$%&*|"] + ["same text"] * 40 + ["Same\ttext", "é" * 49 + "A", "é" * 50 + "A"]


def test_audit_matches_brute_force(spark):
    rows = rows_of(TEXTS)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, len(rows), 3)] + [(0, 0, 1), (3, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert as_dict(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute_audit(rows, labels)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    """Rows of one id keep their own texts' flags; equal rows each count; a null id is never a copy."""
    rows = [(1, "a b", "en", "s", 1)] * 5 + [(1, "w " * 300, "en", "s", 1), (None, "a b", "en", "s", 1), (None, None, "en", None, 1), (2, "a b", "en", "t", 1), (2, "|", "en", "t", 1), (2, "|", "en", "t", 1)]
    docs = spark.createDataFrame([(*r, 9, "x", "y", "z") for r in rows], SCHEMA + ", mask int, word string, n_words string, digest string")
    got = filter_audit.failures(docs, spark.createDataFrame([(2, 1, 0, 7)], "doc_id long, quality int, toxic int, part int")).collect()
    read = lambda m: "".join(k for b, k in enumerate("ABCDE") if m >> b & 1)
    assert sorted((str(r.doc_id), read(r.mask), r.good, r.toxic) for r in got) == sorted((str(r[0]), f, r[0] == 2, False) for r, f in zip(rows, brute_fails(rows)))
    assert sum(r.mask & 16 > 0 for r in got) == 1


def test_word_totals(spark):
    rows = rows_of(TEXTS)
    got = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.word_totals(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()}
    assert got == {r[0]: (len(words(r[1])), len(set(words(r[1])))) for r in rows}


def test_no_rows_and_other_numbers_of_filters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    flags = spark.createDataFrame([("p", m, False, False) for m in (0, 1, 3, 3, 2)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.interactions(flags, "XY").collect()}
    assert got == {("XY", 1): (2, 3, 0, 4), ("XY", 2): (1, 1, 2, 4), ("YX", 1): (2, 3, 0, 4), ("YX", 2): (1, 1, 2, 4)}


@pytest.mark.parametrize("letters", ["A", "ABC"])
def test_steps_are_all_orders(letters):
    import json

    rows = json.loads(filter_audit.steps(letters))
    assert len(rows) == len(list(itertools.permutations(letters))) * len(letters)
