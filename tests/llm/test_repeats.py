import hashlib
import random

import pytest

from tessera.llm import repeats
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.substring_dedup import substring_digests

from .fixtures import awkward, frame, words


def brute_words(texts, t=13):
    least = {}
    for i, text in enumerate(texts):
        w = words(text)
        for a in range(len(w) - t + 1):
            least.setdefault(tuple(w[a : a + t]), i)
    out = {}
    for i, text in enumerate(texts):
        w = words(text)
        cut = set()
        for a in range(len(w) - t + 1):
            if least[tuple(w[a : a + t])] < i:
                cut |= set(range(a, a + t))
        kept = " ".join(x for j, x in enumerate(w) if j not in cut)
        out[i] = (len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_substring_matches_brute_force(spark, monkeypatch, seed, small):
    if small:  # chunks of a few documents, so that rows meet across chunks and batches
        monkeypatch.setattr("tessera.llm.repeats.SEED_CHUNK", 900)
    texts = awkward(seed)
    got = {r[0]: tuple(r)[1:] for r in substring_digests(frame(spark, texts, 5)).collect()}
    assert got == brute_words(texts)


def brute_lines(texts, t=3, lone=13):
    units = [[(k, x) for k, x in enumerate((text or "").split("\n")) if words(x)] for text in texts]
    least, first = {}, {}
    for i, u in enumerate(units):
        for a, (_, x) in enumerate(u):
            first.setdefault(x, (i, a))
        for a in range(len(u) - t + 1):
            least.setdefault(tuple(x for _, x in u[a : a + t]), (i, a))
    out = {}
    for i, (text, u) in enumerate(zip(texts, units)):
        cut = {k for a, (k, x) in enumerate(u) if len(words(x)) >= lone and first[x] < (i, a)}
        for a in range(len(u) - t + 1):
            if least[tuple(x for _, x in u[a : a + t])] < (i, a):
                cut |= {k for k, _ in u[a : a + t]}
        out[i] = (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut), len(u), len(cut))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["alpha beta", "gamma", "", " ", "delta é", "eps", "zeta zeta", "eta\t", "theta\r"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(40)] + [None, "", "one", "\n\n", "\n".join(["same"] * 30)]
    long = [" ".join(f"w{j}" for j in range(n)) for n in (12, 13, 14, 60)]
    texts += ["\n".join(rng.choice(lines + long * 2) for _ in range(rng.randint(0, 12))) for _ in range(20)] + [long[1], long[1], long[0], long[0]]
    texts += texts[:4] + ["\n".join(f"line {i}" for i in range(3000))] * 2
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in dedup_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_stream_state_is_independent_of_batches():
    """The settling pass gives the same rows however its sorted input is cut into batches."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = [(int(k), int(s), int(d), (int(p) << 32) | int(p) + 13) for k, s, d, p in zip(*(rng.integers(0, n, 400) for n in (9, 4, 5, 50)))]
    rows += [(3, repeats.MARK, repeats.MARK, repeats.LONE_MARK)]
    rows = sorted(set(rows))

    def run(size):
        out = set()
        cuts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cut)] + [pa.nulls(len(cut), pa.binary()), pa.array([0] * len(cut))], schema=repeats._ROWS) for cut in cuts]
        covered, seeds = {}, {}
        for b in repeats._settle_seeds(batches):
            for doc, seed, runs, _ in zip(*(c.to_pylist() for c in b.columns)):
                (seeds if seed else covered).setdefault(doc, set()).update(map(tuple, np.frombuffer(runs, "<i4").reshape(-1, 2).tolist()))
        flat = {d: {x for a, b in v for x in range(a, b)} for d, v in covered.items()}
        return flat, {d: frozenset(v) for d, v in seeds.items()}

    want = run(10_000)
    for size in (1, 2, 3, 7, 50):
        assert run(size) == want


def test_empty_table_and_clashing_names(spark):
    empty = frame(spark, ["a"]).where("false")
    assert substring_digests(empty).count() == 0 and dedup_lines(empty).count() == 0
    odd = frame(spark, awkward(5)).selectExpr("*", "1 AS runs", "2 AS doc", "'x' AS key", "3 AS n_removed_lines", "4 AS __runs_")
    out = dedup_lines(odd)
    assert out.count() == odd.count() and {"runs", "doc", "key"} <= set(out.columns)
    ids = odd.selectExpr("CAST(NULL AS long) doc_id", "text")
    assert substring_digests(ids).where("n_removed > 0").count() == 0
    twice = odd.select("doc_id", "text").union(odd.select("doc_id", "text"))
    assert substring_digests(twice).count() == 2 * odd.count()


def twins():
    """Two words of 1,024 letters that a polynomial in any odd base maps to one number modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_units_with_one_weak_hash_stay_apart(spark):
    import numpy as np

    from tessera.llm import textkit as tk

    one, two = twins()
    raw = np.frombuffer((one + two).encode(), np.uint8)
    assert len(set(tk.unit_hashes(raw, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    body = [f"word{i}" for i in range(12)]
    texts = [" ".join([*body, one]), " ".join([*body, two]), "\n".join(["x", "y", one]), "\n".join(["x", "y", two]), "\n".join([one, "p q"] * 3), "\n".join([two, "p q"] * 3)]
    texts += [" ".join([one, two] * 20), " ".join([two, one] * 20)]
    got = {r[0]: tuple(r)[1:] for r in substring_digests(frame(spark, texts)).collect()}
    assert got == brute_words(texts) and got[1][1] == 0
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in dedup_lines(frame(spark, texts)).collect()} == brute_lines(texts)
    from tessera.llm import docstats

    from .test_quality import brute_counts

    blobs = ["\n".join(["a b " + w, "c", "d"]) for w in (one, two)]
    blob = "\n".join(blobs)
    got, _ = docstats.counts(np.frombuffer(blob.encode(), np.uint8), np.array([0, len(blob)]))
    want = brute_counts(blob)
    assert {k: int(got[k][0]) for k in want} == want


def shared_ids(seed):
    """Rows of which three share an id each, most with different texts."""
    rng = random.Random(seed)
    texts = [t for t in awkward(seed, 90)[:-1]]
    lines = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 15))) for _ in range(12)]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(i // 3, t) for i, t in enumerate(texts)] + [(1, "A b c d e f g h i j k l m n"), (5, "A b c d e f g h i j k l m n"), (5, " ".join(f"z{i}" for i in range(20)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_rows_of_a_repeated_id_are_cut_by_their_own_text(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "SEED_CHUNK", 300)
    rows = shared_ids(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert sorted(tuple(r) for r in substring_digests(docs).collect()) == sorted(want) and sum(r[2] for r in want) > 100

    full = lambda t: [x for x in (t or "").split("\n") if words(x)]
    runs, lone = {}, {}
    for i, t in rows:
        f = full(t)
        for k, line in enumerate(f):
            if k + 3 <= len(f):
                runs[tuple(f[k : k + 3])] = min(i, runs.get(tuple(f[k : k + 3]), i))
            if len(words(line)) >= 13:
                lone[line] = min(i, lone.get(line, i))
    want = []
    for i, t in rows:
        f, gone = full(t), set()
        for k, line in enumerate(f):
            if k + 3 <= len(f) and (runs[tuple(f[k : k + 3])] < i or any(f[j : j + 3] == f[k : k + 3] for j in range(k))):
                gone |= {k, k + 1, k + 2}
            if len(words(line)) >= 13 and (lone[line] < i or line in f[:k]):
                gone.add(k)
        kept, at = [], -1
        for line in (t or "").split("\n"):
            at += bool(words(line))
            if not words(line) or at not in gone:
                kept.append(line)
        want.append((i, None if t is None else "\n".join(kept), len(gone)))
    got = [(r.doc_id, r.text, r.n_removed_lines) for r in dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in want) > 50
