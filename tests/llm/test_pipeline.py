import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, mixing, quality_rules

from .test_quality import sample
from .test_repeats import brute_lines
from .test_simhash import brute_similar


def table(spark, folder):
    rng = random.Random(5)
    texts, marks = sample(9, 60)
    good = [t for t, (_, q, _) in zip(texts, marks) if q]
    shared = "\n".join(f"shared line {i} of the passage " + " ".join(good[0].split()[i : i + 6]) for i in range(4))
    texts = [t + "\n" + shared if i % 10 == 0 else t for i, t in enumerate(texts)]
    texts += [good[3], good[3] + " extra", good[4].replace("river", "rivers", 1), None, "", "too short"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_pipeline_matches_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows = table(spark, folder)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert all(len((rows[i][1] or "").split()) >= 50 for i in kept) and len(kept) > 50
    ids = sorted(kept)
    cut = brute_lines([rows[i][1] for i in ids])
    texts = {i: cut[k][0] for k, i in enumerate(ids)}
    assert any(cut[k][2] for k in cut)
    groups = brute_similar([texts[i] for i in ids])
    left = [i for k, i in enumerate(ids) if groups[k] == k]
    assert len(left) < len(ids)
    mixed = spark.createDataFrame([(i, texts[i], rows[i][3]) for i in left], "doc_id long, text string, source string")
    repeats = {r.doc_id: r.repeats for r in mixing.mix(mixed).collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, n in repeats.items():
        tokens = library.encode_ordinary(texts[i])
        want += [(i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] * n
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]


def test_pipeline_of_awkward_tables(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.union(docs).union(docs.selectExpr("CAST(NULL AS long)", "text", "lang", "source", "n_chars"))
    for k, rows in enumerate((docs.where("false"), odd)):
        rows.write.parquet(f"{folder}/{k}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{folder}/{k}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/0").count() == 0
    found = corpus_pipeline.run(spark, f"{folder}/1")
    assert found.where("doc_id is null").count() > 0 and found.where("doc_id is not null").count() > 0
