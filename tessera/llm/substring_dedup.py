"""Substring dedup: passages that an earlier document has are cut out, by seed and extend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .repeats import packed, repeated_runs, text_tag, unpack_runs, units, unpacked

WINDOW_WORDS = 13
SEED_WORDS = 5


def apply_runs(docs: DataFrame, runs: DataFrame, out_ddl: str, worker) -> DataFrame:
    """docs (doc_id, text and more) left-joined with their runs, given to a batch worker with the
    texts restored and a last column __runs (null: none)."""
    texts = packed(docs.withColumn("__tag", text_tag()))
    runs = runs.withColumnsRenamed({"doc": "__doc", "tag": "__own", "runs": "__runs"}).hint("merge")
    joined = texts.join(runs, (texts.doc_id == F.col("__doc")) & (F.col("__tag") == F.col("__own")), "left").drop("__doc", "__tag", "__own")
    return joined.mapInArrow(lambda batches: worker(unpacked(batches)), out_ddl)


def kept_words(batches, kind: str = "word"):
    """(batch, i, number of words, number removed, kept words as bytes) of every text."""
    for batch, raw, offsets in tk.chunks(batches):
        starts, ends, before = units(kind, raw, offsets)
        data = raw.tobytes()
        where = batch.schema.get_field_index("__runs")
        for i, blobs in enumerate(batch.column(where).to_pylist()):
            s, e = starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]]
            gone = 0
            if blobs:
                a, b = unpack_runs(blobs)
                cut = tk.ranges_to_mask(len(s), np.minimum(a, len(s)), np.minimum(b, len(s)))
                gone = int(cut.sum())
                s, e = s[~cut], e[~cut]
            yield batch, i, len(s) + gone, gone, b" ".join([data[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])


def dedup_substrings(docs: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """Remove each word that a window of `window` words covers whose words also start in a document
    with a smaller doc_id, windows judged on the input. Returns doc_id, n_words, n_removed, text
    (the kept words joined by one space); one row for each row of docs.

    Null or empty text: no words, nothing removed, empty text. Null doc_id: never removed from nor
    matched. Rows that repeat a doc_id don't cover each other. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def worker(batches):
        for rows in _grouped(kept_words(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py() for b, i, *_ in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4].decode() for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return apply_runs(plain, repeated_runs(plain, "word", window, seed), "doc_id long, n_words long, n_removed long, text string", worker)


def substring_digests(docs: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """dedup_substrings with the kept text as its SHA-256."""
    out = dedup_substrings(docs, window, seed)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _grouped(rows, most: int = 512):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if len(held) >= most or size >= 4 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
keyed AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS body FROM win),
least AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY body) AS least FROM keyed),
cut AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS p FROM least WHERE least < doc_id) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(gone, p)))) END AS rest
  FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(rest, ' '), '')) AS kept_sha256 FROM kept
"""
