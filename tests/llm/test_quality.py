import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import docstats, quality_gbdt, quality_rules
from tessera.llm import textkit as tk

from .fixtures import awkward, frame, words


def brute_counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct": len(set(w)), "n_chars": len(text), "n_lines": text.count("\n") + 1, "longest": max([len(x.encode()) for x in w], default=0)}


def sample(seed=0, n=400):
    rng = random.Random(seed)
    good, bad = [], []
    for i in range(n):
        body = [rng.choice(["the", "of", "stone", "river", "walks", "über", "light"]) + rng.choice(["", ".", ",", "s"]) for _ in range(rng.randint(60, 120))]
        good.append(" ".join(body))
        bad.append(" ".join(x.upper() + "!!" for x in body))
    texts = [t for pair in zip(good, bad) for t in pair]
    return texts, [(i, 1 - i % 2, 0) for i in range(len(texts))]


def test_counts_match_brute_force():
    texts = awkward(11)[:-2] + ["a b c a b c", "x\nx\n\n x\nx", "|| <a> #"]
    blobs = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    got, _ = docstats.counts(np.frombuffer(b"".join(blobs), np.uint8), offsets)
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert {k: int(got[k][i]) for k in want} == want, t


def test_forest_separates_and_holds_out(spark):
    texts, marks = sample()
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5000, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts + [None, "", "z"]).withColumn("score", F.lit(1))
    rows = {r.doc_id: r for r in quality_gbdt.score_quality(docs, labels).collect()}
    assert len(rows) == len(texts) + 3
    for i, r in rows.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(rows[i].predicted == q for i, q, _ in marks if rows[i].held_out)


def test_traversal_equals_walking_the_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    f = quality_gbdt.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7, depth=3)
    for row, got in zip(x, f.margins(x)):
        want = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            want += leaf[node - len(feature)]
        assert abs(want - got) < 1e-9
    assert quality_gbdt.train(np.zeros((0, 4)), np.zeros(0)).scores(x)[0] == 0.5


def test_rules_match_brute_force_and_keep_clean_texts(spark):
    texts, marks = sample(3, 200)
    extra = awkward(12)[:-2] + ["word " * 60, "a b c d " * 20]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts + extra).withColumn("kept", F.lit("x"))
    rows = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(texts + extra):
        want = brute_counts(t)
        assert all(rows[i][k] == want[k] for k in quality_rules.FIELDS)
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert rows[i].base_failed == failed and not (failed and rows[i].kept)
    tested = [(rows[i].kept, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0 and not rows[i].base_failed]
    assert np.mean([k == bool(q) for k, q in tested]) > 0.97
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)


def test_margins_are_means_of_weights():
    rng = np.random.default_rng(2)
    model = quality_rules.Model(rng.normal(size=(3, 1 << quality_rules.BITS)).astype(np.float32), 0.5, 1.0, 0.0)
    texts = ["", "a", "a b", "abc", "abcd", "ab cd ef gh", "é" * 5]
    blobs = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    together = model.margins(raw, offsets, docstats.counts(raw, offsets)[1])
    for i, b in enumerate(blobs):
        one, at = np.frombuffer(b, np.uint8), np.array([0, len(b)])
        assert abs(together[i] - model.margins(one, at, docstats.counts(one, at)[1])[0]) < 1e-5
        c, v = quality_rules.shares(one, at)[0]
        assert abs(together[i] - 0.5 - (model.weights.ravel()[c] * v).sum()) < 1e-5


def test_character_grams_are_of_code_points():
    text = "añbé€😀x"
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(raw)])
    *_, (slots, before) = quality_rules.hashed(raw, offsets, docstats.counts(raw, offsets)[1])
    assert before.tolist() == [0, len(text) - 3] and len(set(slots.tolist())) == len(text) - 3


def test_the_slots_that_tell_labels_apart_are_chosen():
    n0, n1 = np.array([50, 0, 25, 3]), np.array([50, 40, 25, 0])
    assert quality_rules.chosen_slots(n0, n1, (100, 100), 10_000).tolist() == [0, 1, 2, 3]
    assert quality_rules.chosen_slots(n0, n1, (100, 100), 2).tolist() == [1, 3]
    assert quality_rules.chosen_slots(n0, n1, (100, 100), 3).tolist() == [0, 1, 3]


def test_long_texts_have_as_many_features(spark):
    texts, marks = sample(8, 60)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    short, long = (np.count_nonzero(quality_rules.fit(frame(spark, [t + f" {t}" * k for t in texts]), labels, features=500).weights) for k in (0, 40))
    assert short == long == 500


def test_few_features_still_separate(spark):
    texts, marks = sample(4, 150)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    model = quality_rules.fit(docs, labels, features=100)
    assert np.count_nonzero(model.weights) <= 100
    rows = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels, model=model).collect()}
    assert np.mean([rows[i] == bool(q) for i, q, _ in marks]) > 0.9
    twice = docs.union(docs).union(docs.selectExpr("CAST(NULL AS long)", "text", "lang", "source", "n_chars"))
    assert quality_rules.judge(twice, labels, model=model).count() == 3 * docs.count()


def test_empty_tables(spark):
    docs, labels = frame(spark, ["a b"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = docs.where("false")
    assert quality_gbdt.score_quality(none, labels).count() == 0 and quality_rules.judge(none, labels).count() == 0
    assert quality_gbdt.score_quality(docs, labels).first().score == 0.5
    assert quality_rules.judge(docs, labels).first().base_failed


def test_scores_of_rows_without_or_with_a_repeated_id(spark):
    texts, marks = sample(6, 60)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).selectExpr("*", "1 AS score", "2 AS held_out", "'x' AS label", "3 AS predicted")
    odd = docs.union(docs).union(docs.selectExpr("CAST(NULL AS long)", "text", "lang", "source", "n_chars", "1", "2", "'x'", "3"))
    rows = quality_gbdt.score_quality(odd, labels).collect()
    assert len(rows) == 3 * len(texts) and not any(r.held_out for r in rows if r.doc_id is None)
    by = {}
    for r in rows:
        if r.doc_id is not None:
            by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
