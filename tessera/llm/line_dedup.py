"""Line dedup: runs of lines, and long lines, that stand earlier are deleted, by winnowing over line hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .repeats import repeated_runs, unpack_runs
from .substring_dedup import apply_runs

RUN_LINES = 3
SEED_LINES = 2
LONE_WORDS = 13


def _cut_lines(batches):
    """Texts without their covered lines; yields (batch, i, lines with a word, lines removed, text)."""
    for batch, raw, offsets in tk.chunks(batches):
        runs = batch.column(batch.schema.get_field_index("__runs")).to_pylist()
        starts, ends, before = tk.lines_of(raw, offsets)
        full = tk.holds_word(raw, starts, ends)
        data = raw.tobytes()
        for i, blobs in enumerate(runs):
            a, b = before[i], before[i + 1]
            n = int(full[a:b].sum())
            if not blobs:
                yield batch, i, n, 0, data[offsets[i] : offsets[i + 1]]
                continue
            s, e = unpack_runs(blobs)
            gone = np.flatnonzero(full[a:b])[tk.ranges_to_mask(n, np.minimum(s, n), np.minimum(e, n))]
            keep = np.ones(b - a, bool)
            keep[gone] = False
            at = np.flatnonzero(keep) + a
            yield batch, i, n, len(gone), b"\n".join([data[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])


def dedup_lines(docs: DataFrame, run: int = RUN_LINES, seed: int = SEED_LINES, lone: int = LONE_WORDS) -> DataFrame:
    r"""Delete every run of `run` or more lines, and every line of `lone` or more words (0: none by itself),
    that also stands earlier: in a document with a smaller doc_id, or before in the same text. Lines are
    split at \n and named by 128-bit digests of their bytes; lines without a word are never part of a run
    and never deleted. Runs are judged on the input. Kept lines are joined by \n again.

    All columns of docs return, text replaced, then n_lines (lines with a word) and n_removed_lines;
    columns of docs with those names go. Null text stays null. Null doc_id: never changed nor matched
    by other documents. Rows that repeat a doc_id don't cover each other. An empty table stays so.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    names = docs.columns
    at, ident = names.index("text"), F.col("doc_id").cast("long")
    found = repeated_runs(docs.select(ident.alias("doc_id"), "text"), "line", run, seed, within=True, lone_words=lone)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_removed_lines long"

    def give(batch, rows):
        nulls = batch.column(at).is_null().to_pylist()
        texts = pa.array([None if nulls[i] else t.decode() for i, _, _, t in rows], pa.string())
        columns = [texts if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], [*names, "n_lines", "n_removed_lines"])

    def worker(batches):
        now, rows = None, []
        for batch, i, n, gone, text in _cut_lines(batches):
            if now is not None and batch is not now:
                yield give(now, rows)
                rows = []
            now = batch
            rows.append((i, n, gone, text))
        if now is not None:
            yield give(now, rows)

    return apply_runs(docs, found, ddl, worker)


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
full_ AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM full_ WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
late AS (SELECT doc_id, pos, 3 AS n FROM win WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1
  UNION ALL SELECT doc_id, pos, 1 FROM full_ WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 13 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT f.doc_id, f.k FROM full_ f JOIN late ON f.doc_id = late.doc_id AND f.pos BETWEEN late.pos AND late.pos + late.n - 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL) AS body FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed_lines, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM full_ GROUP BY doc_id) f ON d.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""
