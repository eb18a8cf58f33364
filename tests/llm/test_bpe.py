import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

from .fixtures import awkward, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(texts):
    blobs = [t.encode() for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)


def test_ids_equal_the_library_s(ranks, reference):
    tokenizer = bpe.Tokenizer(ranks)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'S", "'d", "a", "Z", "é", "1", "²", "½", "!", "-", "¿", "\xa0", "　", "\x85", "\x1c", "中", "😀", "́", "𝟘", "٣", "re", "s", "t", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + [t or "" for t in awkward(13)] + ["ab" * 20_000, " " * 5000, "é" * 4000]
    for memo in (bpe.MEMO, 500):
        bpe_memo, bpe.MEMO = bpe.MEMO, memo
        raw, offsets = packed(texts)
        ids, before, decoded = bpe.encoded_chunk(tokenizer, raw, offsets)
        bpe.MEMO = bpe_memo
        assert decoded == raw.tobytes()
        for i, want in enumerate(reference.encode_ordinary_batch(texts)):
            assert ids[before[i] : before[i + 1]].tolist() == want, texts[i][:80]


def test_perfect_hash_is_minimal_and_refuses_others(ranks):
    keys = list(ranks)[:5000]
    table = bpe.PerfectHash(bpe.Tokenizer.hashes_of(keys))
    assert sorted(table.key_at.tolist()) == list(range(5000))
    assert table.find(bpe.Tokenizer.hashes_of(keys)).tolist() == list(range(5000))
    assert (table.find(bpe.Tokenizer.hashes_of([k + b"\0x" for k in keys])) == -1).all()


def test_query_rows(spark, reference):
    texts = awkward(14) + [None, ""]
    got = {r.doc_id: r for r in bpe.tokenized(frame(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rows = bpe.tokenized(frame(spark, texts), PATH, digests=False).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.ids == reference.encode_ordinary(texts[r.doc_id] or "") for r in rows)
    assert bpe.tokenized(frame(spark, ["a"]).where("false"), PATH).count() == 0


def test_pre_tokens_with_one_weak_hash(spark, reference):
    from .test_repeats import twins

    texts = [*twins(), " ".join(twins()), "x " * 3 + twins()[1]]
    got = {r.doc_id: r.ids for r in bpe.tokenized(frame(spark, texts), PATH, digests=False).collect()}
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts))


def test_rows_with_null_or_repeated_id_and_clashing_columns(spark, reference):
    docs = frame(spark, ["a b", "c d e"]).selectExpr("CAST(NULL AS long) AS doc_id", "text", "1 AS n_tokens", "'x' AS ids", "2 AS decoded_sha256")
    rows = bpe.tokenized(docs.union(docs), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((None, len(reference.encode_ordinary(t))) for t in ["a b", "c d e"] * 2)
