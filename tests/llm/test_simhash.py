import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components

from .fixtures import awkward, frame, words


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, distance=3):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_near_duplicates_match_brute_force(spark):
    texts = awkward(4) + [" ".join(["Word"] * k) for k in range(1, 5)] + ["A b C d É"]
    base = " ".join(str(i) for i in range(400))
    texts += [base, base.replace(" 77 ", " x "), base.replace(" 5 ", " y "), base.upper()]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, brute_components(fps)))}


def test_links_cover_every_pair_within_three_bits(spark):
    rng = random.Random(3)
    values = []
    for _ in range(30):  # chains and dense balls around random centres
        centre = rng.getrandbits(64)
        values.append(centre)
        for _ in range(12):
            v = rng.choice(values[-5:])
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.append(v)
    values = list(dict.fromkeys(values))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.component for r in components(links).collect()}
    want = brute_components(values)
    groups = {}
    for v, c in zip(signed, want):
        groups.setdefault(c, []).append(v)
    for members in groups.values():
        assert {found.get(v, v) for v in members} == {min(members)}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (2000, 2001), (2001, 2000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1300)}, 2000: 2000, 2001: 2000}


def test_empty_and_null_rows(spark):
    assert simhash.near_duplicates(frame(spark, ["a"]).where("false")).count() == 0
    docs = spark.createDataFrame([(None, "a b c", 1), (2, "a b c", 1), (2, "a b c", 1), (5, None, 1), (3, "", 1)], "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == [(2, 2), (2, 2), (3, 3), (5, 3), (None, 2)]
    assert sorted(str(r.doc_id) for r in simhash.dedup_near(docs).collect()) == ["2", "2", "3", "None"]


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """With every shared key cut before the exchange, and in the kernel, the components are those of all pairs."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 400:
        v = rng.choice(list(values)[-40:])
        for b in rng.sample(range(64), rng.randint(1, 3)):
            v ^= 1 << b
        values.add(v)
    values = sorted(values)
    fps = np.array(values, np.uint64).view(np.int64)
    want = brute_components(values)
    monkeypatch.setattr(simhash, "HOT_LEAST", 1)
    monkeypatch.setattr(simhash, "HOT_KEYS", 10**9)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in fps], "fp long"))
    found = {r.node: r.component for r in components(links).collect()}
    groups = {}
    for v, c in zip(fps.tolist(), want):
        groups.setdefault(c, []).append(v)
    for members in groups.values():
        assert {found.get(v, v) for v in members} == {min(members)}
    # the kernel: fingerprints of one key agree in the upper half
    monkeypatch.setattr(simhash, "MANY", 5)
    same = np.unique(fps & np.int64(0xFFFFFFFF) | np.int64(7 << 40))
    got = simhash.links_of(1, same, 3)
    roots = brute_components([int(x) for x in same])
    parent = {int(x): int(x) for x in same}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        assert (a ^ b).bit_count() <= 3
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert len({root(int(x)) for x in same}) == len(set(roots))


def brute_wide(text):
    """The four 64-bit columns, with Python's integers."""
    import hashlib

    from tessera.llm import textkit as tk

    m = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    out = []
    for k, size in enumerate((2, 2, 5, 5)):
        half = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=16, key=b"tessera units").digest()[8 * (k % 2) : 8 * (k % 2) + 8], "little") for x in w]
        base = int(tk.BASES[k % 2])
        if len(w) >= size:
            grams = []
            for i in range(len(w) - size + 1):
                acc = 0
                for h in half[i : i + size]:
                    acc = (acc * base + h) & m
                grams.append(mix(acc))
        elif w:
            base = int(tk.BASES[2])
            grams = [mix((sum(h * pow(base, i, 2**64) for i, h in enumerate(half)) + len(w) * 0xC2B2AE3D27D4EB4F) & m)]
        else:
            grams = []
        grams = set(grams)
        out.append(sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams)))
    return out


def shingles(text, size=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_similar(texts, bits=36):
    """Components over all pairs that the index proposes and whose shingle sets agree to 0.8."""
    prints, sets = [brute_wide(t) for t in texts], [shingles(t) for t in texts]
    segments = [[v >> 21 * s & (1 << 21) - 1 for v in p[:2] for s in range(3)] for p in prints]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            apart = sum((prints[i][k] ^ prints[j][k]).bit_count() for k in (2, 3))
            if prints[i] == prints[j] or apart <= bits and any((x ^ y).bit_count() <= 1 for x, y in zip(segments[i], segments[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited(seed=2, bases=12, copies=8, length=150):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(copies):
            body = list(base)
            for _ in range(rng.randint(0, 6)):
                body[rng.randrange(len(body))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(body))
    return out


def test_similar_groups_match_brute_force(spark, monkeypatch):
    texts = edited() + awkward(6)[:40] + [None, "", "one", "One", "one two three"]
    want = dict(enumerate(brute_similar(texts)))
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()} == want
    assert len(set(want.values())) < len(texts) - 60
    monkeypatch.setattr(simhash, "HOT_LEAST", 0)
    monkeypatch.setattr(simhash, "HOT_KEYS", 10**9)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "MANY", 4)  # on the driver: every key is dealt in parts that share its hubs
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()} == want


def test_parts_of_a_hot_key_lose_no_pair(spark, monkeypatch):
    """On the driver: every key is dealt in parts of a row that share no hub, and then in tiles of three rows."""
    texts = edited(7, 4, 9)
    want = dict(enumerate(brute_similar(texts)))
    for name, value in {"HOT_LEAST": 0, "HOT_KEYS": 10**9, "SAMPLE": 1, "MANY": 1, "HUBS": 0, "TILE": 3}.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()} == want
    assert len(set(want.values())) < len(texts) - 12


def test_what_was_proposed_is_compared_again_between_components(spark):
    """Every pair under a key that is not hot, in two components and not proposed."""
    texts = edited(7, 4, 9)
    own = frame(spark, texts).selectExpr("doc_id", "text", "doc_id AS text_key").mapInArrow(simhash._wide_batches, "doc_id long, text_key long, a long, b long, c long, d long, grams int")
    nodes = own.selectExpr("a", "b", "c", "d", "doc_id AS id", "grams")
    every = spark.createDataFrame([(0, i) for i in range(len(texts))], "u long, v long")
    alone = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, component long")
    got = {tuple(r) for r in simhash.crossing_links(nodes, alone, every, 36, 80).collect()}
    prints = [brute_wide(t) for t in texts]
    apart = lambda i, j, ks: sum((prints[i][k] ^ prints[j][k]).bit_count() for k in ks)
    segments = [[v >> 21 * s & (1 << 21) - 1 for v in p[:2] for s in range(3)] for p in prints]
    alike = lambda i, j: 100 * min(len(shingles(texts[i])), len(shingles(texts[j]))) >= 80 * max(len(shingles(texts[i])), len(shingles(texts[j])))
    assert got == {(i, j) for j in range(len(texts)) for i in range(1, j) if apart(i, j, (2, 3)) <= 36 and alike(i, j) and any((x ^ y).bit_count() <= 1 for x, y in zip(segments[i], segments[j]))} and got


def test_crossing_pairs_are_all_pairs_of_two_components(monkeypatch):
    rng = np.random.default_rng(5)
    c, d = rng.integers(0, 2**63, (2, 60))
    c[20:], d[20:] = np.resize(c[:20], 40) ^ 1 << np.arange(40), np.resize(d[:20], 40)
    component, grams = np.arange(60) % 7, rng.integers(80, 120, 60)
    for cut, matrix in ((60, 256), (25, 256), (25, 8), (60, 8)):
        monkeypatch.setattr(simhash, "MATRIX", matrix)
        monkeypatch.setattr(simhash, "COLUMNS", 16)
        part = (np.arange(60) >= cut).astype(np.int64)
        got = [p for u, v in simhash.crossing_pairs(np.arange(60), c, d, component, grams, part, 2, 80) for p in zip(u.tolist(), v.tolist())]
        near = lambda i, j: sum(int(x[i] ^ x[j]).bit_count() for x in (c, d)) <= 2 and component[i] != component[j] and 100 * min(grams[i], grams[j]) >= 80 * max(grams[i], grams[j])
        assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if near(i, j) and (cut == 60 or part[i] != part[j])] and got


def test_dedup_similar_keeps_the_smallest_and_rows_without_id(spark):
    texts = edited(5, 3, 4)
    docs = frame(spark, texts).selectExpr("CASE WHEN doc_id <> 2 THEN doc_id END AS doc_id", "text", "1 AS a", "2 AS id", "3 AS sub", "4 AS component_id")
    kept = simhash.dedup_similar(docs.union(docs))
    groups = brute_similar([t for i, t in enumerate(texts) if i != 2])
    ids = [i for i in range(len(texts)) if i != 2]
    want = [i for k, i in enumerate(ids) if groups[k] == k]
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want * 2 + [None] * 2))
    assert simhash.similar_groups(docs.where("false")).count() == 0


def test_separators_join_nothing(spark):
    """Texts that share a long run of dashes and nothing else."""
    rng = random.Random(8)
    for dashes, own in ((60, 140), (60, 400), (100, 1000)):
        texts = [" ".join(["-"] * dashes + [f"w{rng.randint(0, 10**9)}" for _ in range(own)]) for _ in range(10)]
        docs = frame(spark, texts)
        assert simhash.dedup_similar(docs).count() == 10
        assert simhash.dedup_similar(docs.union(frame(spark, [texts[3] + " end"]).selectExpr("doc_id + 50 AS doc_id", "text", "lang", "source", "n_chars"))).count() == 10


def test_rows_of_a_repeated_id_go_for_their_own_text(spark):
    rng = random.Random(9)
    a, z = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(40)) for c in "az")
    docs = spark.createDataFrame([(1, a), (5, a), (5, z), (5, z + " end"), (7, z)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.dedup_similar(docs).collect())) == sorted([(1, a), (5, z), (5, z + " end")])
    fine = simhash.dedup_near(docs)
    assert sorted(map(tuple, fine.collect()))[:1] == [(1, a)] and (5, z) in map(tuple, fine.collect())


def test_verification_keeps_similar_links_only(spark):
    """Links of texts at 0.79 and at 0.8 of their shingles, and of a text with itself under two keys."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    cut = lambda n: " ".join(base[:-n])  # noqa: E731  100 - n shingles, all of them shared
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate([" ".join(base), cut(20), cut(21), " ".join(base), None, ""])], "doc_id long, text string, text_key long")
    nodes = docs.selectExpr("doc_id + 10 AS id", "doc_id", "text_key")
    links = spark.createDataFrame([(10, 11), (10, 12), (10, 13), (11, 12), (14, 15)], "u long, v long")
    assert {tuple(r) for r in simhash.verified_links(links, nodes, docs).collect()} == {(10, 11), (10, 13), (11, 12), (14, 15)}


def test_links_span_what_is_near(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, (6, 2))
    rows = np.repeat(centres, 9, axis=0)
    for r in rows:
        for b in rng.integers(0, 63, rng.integers(0, 5)):
            r[b % 2] ^= 1 << int(b)
    ident = np.arange(100, 154)
    want = {(100 + i, 100 + j) for i in range(54) for j in range(i) if sum(int(a ^ b).bit_count() for a, b in zip(rows[i].tolist(), rows[j].tolist())) <= 8}
    for most in (256, 8):
        monkeypatch.setattr(simhash, "MATRIX", most)
        got = simhash.near_links(ident, rows[:, 0].copy(), rows[:, 1].copy(), 8)
        assert {(max(p), min(p)) for p in got.tolist()} <= want

        def classes(pairs):
            parent = dict(zip(ident.tolist(), ident.tolist()))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                parent[max(root(a), root(b))] = min(root(a), root(b))
            return [root(int(i)) for i in ident]

        assert classes(got.tolist()) == classes(want) and len(set(classes(want))) < 20
