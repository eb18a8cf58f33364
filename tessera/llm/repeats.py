"""Repeated runs of units (words, lines) across documents, by winnowed seeds and extension.

A window is `length` units in a row. The search finds every window whose units also start in a
document with a smaller id, in time and space linear in the text:

1. Seeds. Each window is owned by the smallest hash of its `seed`-unit grams, which depends on the
   window's units alone, so equal windows have equal owners (winnowing's guarantee). Neighbouring
   windows with one owner form a stretch; a stretch is one row (owner, digest of its whole extent,
   document, position).
2. Join on the owner. Rows are dealt by owner and sorted; equal extents under one owner mean
   that all their windows agree, and those of larger ids are covered. Owners with differing
   extents are kept as seeds to be extended.
3. Extension. The windows of kept stretches, left and right of the seed, are compared by 128-bit
   digests, again dealt out and sorted. What is covered merges into maximal runs.

Rows that repeat a doc_id never cover each other, and each is judged and cut by its own text: a row is named
by doc_id and a hash of its text.

A unit is named by a keyed 128-bit digest of its bytes. Seeds and extents take one half each, windows
both, so units or windows that share one 64-bit hash don't meet.

No pairs are made: a row meets the smallest id of its run only. Before each exchange a chunk
of documents keeps one row per owner or window and settles the rest itself, so a passage that
a third of all documents share costs a row per chunk and not one per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .runtime import written

#: Bytes of text that the seed and window kernels take at once: they hold some thirty bytes for each byte of text.
SEED_CHUNK = 1 << 20
MARK = -(2**63)
COVERED, SEED, LONE_MARK = -2, -3, -1
_ROWS = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("runs", pa.binary()), ("tag", pa.int64())])
_FOUND = pa.schema([("doc", pa.int64()), ("seed", pa.bool_()), ("runs", pa.binary()), ("tag", pa.int64())])
_ROWS_DDL = "key long, span long, doc long, at long, runs binary, tag long"
_FOUND_DDL = "doc long, seed boolean, runs binary, tag long"


def units(kind: str, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, or the lines that hold a word: byte starts, ends, and how many precede each text."""
    if kind == "word":
        return tk.spans_of(raw, offsets)
    starts, ends, before = tk.lines_of(raw, offsets)
    full = tk.holds_word(raw, starts, ends)
    kept = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=kept[1:])
    return starts[full], ends[full], kept[before]


def pack_runs(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ranges by row (doc and tag), merged unless they stay apart, as little-endian int32 pairs: docs, tags, blobs."""
    if not len(docs):
        return docs, tags, []
    order = np.lexsort((starts, tags, docs))
    docs, tags, starts, ends = docs[order], tags[order], starts[order], ends[order]
    cut = np.flatnonzero(_heads(docs, tags))
    blobs = []
    for a, b in zip(cut, np.append(cut[1:], len(docs)), strict=True):
        s, e = (starts[a:b], ends[a:b]) if apart else tk.merged(starts[a:b], ends[a:b])
        blobs.append(np.stack([s, e], 1).astype("<i4").tobytes())
    return docs[cut], tags[cut], blobs


def unpack_runs(blobs) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.concatenate([np.frombuffer(b, "<i4").reshape(-1, 2) for b in blobs]).astype(np.int64)
    return tk.merged(pairs[:, 0], pairs[:, 1])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _stretches(left, right, before, text_of, length: int, seed: int):
    """Neighbouring windows with one owner: (first unit, end, owner, digest of the extent), and every window with both digests."""
    n = len(left) - length + 1
    window = np.flatnonzero(np.arange(n) + length <= before[text_of[:n] + 1]) if n > 0 else np.zeros(0, np.int64)
    if not len(window):
        none = np.zeros(0, np.int64)
        return (none, none, none, none), (none, none, none)
    grams, windows = tk.fixed_digest(left, seed, 0), tk.fixed_digest(right, length, 1)
    owner = grams[:n].copy()
    for j in range(1, length - seed + 1):
        np.minimum(owner, grams[j : j + n], out=owner)
    own = owner[window]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)))
    s, last = window[first], window[np.append(first[1:], len(window)) - 1]
    span = _signed(tk.ranged_digest(windows, s, last + 1, 2))
    return (s, last + length, _signed(own[first]), span), (window, tk.fixed_digest(left, length, 1)[window], windows[window])


def _later(text: np.ndarray, at: np.ndarray, *digests: np.ndarray) -> np.ndarray:
    """Positions whose digests stand before in the same text."""
    order = np.lexsort((at, *digests, text))
    return at[order][~_heads(text[order], *(d[order] for d in digests))]


def _seed_rows(kind: str, length: int, seed: int, within: bool, lone_words: int):
    limit = SEED_CHUNK

    def run(batches):
        for batch, raw, offsets in tk.chunks(batches, limit=limit):
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            starts, ends, before = units(kind, raw, offsets)
            if not len(starts):
                continue
            left, right = tk.named(raw, starts, ends)
            text_of = np.repeat(np.arange(len(ids)), np.diff(before))
            (s, e, key, span), (window, d1, d2) = _stretches(left, right, before, text_of, length, seed)
            w = _later(text_of[window], window, d2, d1) if within else window[:0]
            w_end = w + length
            if lone_words:
                begins = tk.spans_of(raw, offsets)[0]
                lone = np.flatnonzero(np.searchsorted(begins, ends) - np.searchsorted(begins, starts) >= lone_words)
                s, e = np.append(s, lone), np.append(e, lone + 1)
                key, span = np.append(key, _signed(tk.mix(left[lone] + tk.BASES[0]))), np.append(span, _signed(right[lone]))
                if within:
                    more = _later(text_of[lone], lone, right[lone], left[lone])
                    w, w_end = np.append(w, more), np.append(w_end, more + 1)
            if not len(s):
                continue
            text, span = text_of[s], np.maximum(span, MARK + 1)
            doc = ids[text]
            order = np.lexsort((s, doc, span, key))
            key, span, doc, s, e, text = key[order], span[order], doc[order], s[order], e[order], text[order]
            head, key_head = _heads(key, span), _heads(key)
            run = np.cumsum(head) - 1
            key_run = np.cumsum(key_head) - 1
            covered = doc > doc[head][run]
            extents = np.bincount(key_run[head])
            low, high = np.full(len(extents), np.iinfo(np.int64).max), np.full(len(extents), np.iinfo(np.int64).min)
            np.minimum.at(low, key_run[head], doc[head])
            np.maximum.at(high, key_run[head], doc[head])
            many = (extents > 1) & (low != high)
            seeds = ~covered & many[key_run]
            sent = ~covered & ~many[key_run]
            marks = np.unique(key[seeds])
            base = before[text]
            s, e, tag = s - base, e - base, tags[text]
            again = [ids[text_of[w]], tags[text_of[w]], w - before[text_of[w]], w_end - before[text_of[w]]]
            c_docs, c_tags, c_runs = pack_runs(*(np.append(x[covered], y) for x, y in zip((doc, tag, s, e), again, strict=True)))
            r_docs, r_tags, r_runs = pack_runs(doc[seeds], tag[seeds], s[seeds], e[seeds], apart=True)
            count = (int(sent.sum()), len(marks), len(c_docs), len(r_docs))
            passed = np.concatenate([c_docs, r_docs])
            yield _batch(
                _ROWS,
                np.concatenate([key[sent], marks, _signed(tk.mix(passed.astype(np.int64).view(tk.U)))]),
                np.concatenate([span[sent], np.full(count[1], MARK), np.zeros(len(passed), np.int64)]),
                np.concatenate([doc[sent], np.full(count[1], MARK), passed]),
                np.concatenate([(s[sent] << 32) | e[sent], np.full(count[1], LONE_MARK), np.full(count[2], COVERED), np.full(count[3], SEED)]),
                [None] * (count[0] + count[1]) + c_runs + r_runs,
                np.concatenate([tag[sent], np.zeros(count[1], np.int64), c_tags, r_tags]),
            )

    return run


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5)]


def _settle_seeds(batches):
    """Rows sorted by (key, span, doc). What is kept from batch to batch is bounded by one document."""
    held = [np.zeros(0, np.int64)] * 5
    told = np.zeros(0, bool)  # rows of held that were given out before
    for batch in batches:
        if not batch.num_rows:
            continue
        passed = batch.column(3).to_numpy()
        through = (passed == COVERED) | (passed == SEED)
        if through.any():
            part = batch.filter(pa.array(through))
            yield _batch(_FOUND, part.column(2), passed[through] == SEED, part.column(4), part.column(5))
            batch = batch.filter(pa.array(~through))
        fresh = _columns(batch)
        out, held, told = _settled([np.concatenate(x) for x in zip(held, fresh, strict=True)], np.append(told, np.zeros(len(fresh[0]), bool)))
        yield from out
    # what is held at the end is a run of one document or was given out


def _settled(rows, told):
    key, span, doc, at, tag = rows
    if not len(key):
        return [], rows, told
    mark = at == LONE_MARK
    head = _heads(key, span)
    run = np.cumsum(head) - 1
    key_run = np.cumsum(_heads(key)) - 1
    first = doc[head][run]
    covered = ~mark & (doc > first)
    rep = ~mark & ~covered
    extents = np.bincount(key_run, weights=head & ~mark)
    low, high = np.full(len(extents), np.iinfo(np.int64).max), np.full(len(extents), np.iinfo(np.int64).min)
    np.minimum.at(low, key_run[rep], doc[rep])
    np.maximum.at(high, key_run[rep], doc[rep])
    many = ((extents > 1) & (low != high)) | (np.bincount(key_run, weights=mark) > 0)
    seeds = rep & many[key_run] & ~told
    s, e = at >> 32, at & 0xFFFFFFFF
    out = []
    for flag, mine in ((False, covered), (True, seeds)):
        docs, tags, runs = pack_runs(doc[mine], tag[mine], s[mine], e[mine], apart=flag)
        if len(docs):
            out.append(_batch(_FOUND, docs, np.full(len(docs), flag), runs, tags))
    last = key_run == key_run[-1]
    if many[-1]:
        keep = np.flatnonzero(last & rep)[-1:]  # of the last extent, the smallest id
        held = [np.append(v, x[keep]) for v, x in zip((key[-1], MARK, MARK, LONE_MARK, 0), rows, strict=True)]
        return out, held, np.ones(len(held[0]), bool)
    keep = last & rep
    return out, [x[keep] for x in rows], np.zeros(int(keep.sum()), bool)


def _window_rows(kind: str, length: int):
    """From documents with their kept stretches: a row per window, the smallest id of a chunk only."""
    limit = SEED_CHUNK

    def run(batches):
        for batch, raw, offsets in tk.chunks(unpacked(batches), limit=limit):
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            starts, ends, before = units(kind, raw, offsets)
            left, right = tk.named(raw, starts, ends)
            at, text = [], []
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                s, e = unpack_runs(blobs)
                # stretches overlap by length-1 units; windows of the merged range are theirs and few others
                w = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(s, e, strict=True)])
                w = w[w + length <= before[i + 1] - before[i]]
                at.append(w)
                text.append(np.full(len(w), i))
            at, text = np.concatenate(at), np.concatenate(text)
            where = at + before[text]
            d1, d2 = _signed(tk.fixed_digest(left, length, 1)[where]), _signed(tk.fixed_digest(right, length, 2)[where])
            doc, tag = ids[text], tags[text]
            order = np.lexsort((at, tag, doc, d2, d1))
            d1, d2, doc, tag, at = d1[order], d2[order], doc[order], tag[order], at[order]
            head = _heads(d1, d2)
            covered = doc > doc[head][np.cumsum(head) - 1]
            docs, own, runs = pack_runs(doc[covered], tag[covered], at[covered], at[covered] + length)
            # of a window that its row repeats, one row with all its places
            sent = np.flatnonzero(~covered)
            first = np.flatnonzero(_heads(d1[sent], d2[sent], tag[sent]))
            size = np.diff(np.append(first, len(sent)))
            places = [None] * len(first)
            for k in np.flatnonzero(size > 1):
                here = at[sent[first[k] : first[k] + size[k]]]
                places[k] = np.stack(tk.merged(here, here + length), 1).astype("<i4").tobytes()
            sent = sent[first]
            yield _batch(
                _ROWS,
                np.concatenate([d1[sent], _signed(tk.mix(docs.astype(np.int64).view(tk.U)))]),
                np.concatenate([d2[sent], np.zeros(len(docs), np.int64)]),
                np.concatenate([doc[sent], docs]),
                np.concatenate([at[sent], np.full(len(docs), COVERED)]),
                places + runs,
                np.concatenate([tag[sent], own]),
            )

    return run


def _settle_windows(length: int):
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(3).to_numpy()
            through = at == COVERED
            if through.any():
                part = batch.filter(pa.array(through))
                yield _batch(_FOUND, part.column(2), np.zeros(part.num_rows, bool), part.column(4), part.column(5))
                batch = batch.filter(pa.array(~through))
                if not batch.num_rows:
                    continue
            rows = _columns(batch)
            many = ~batch.column(4).is_null().to_numpy(zero_copy_only=False)
            ahead = 0
            if held is not None:
                ahead = 1
                rows = [np.append(v, x) for v, x in zip(held, rows, strict=True)]
            d1, d2, doc, at, tag = rows
            head = _heads(d1, d2)
            first = doc[head][np.cumsum(head) - 1]
            covered = doc > first
            single = covered & ~np.append(np.zeros(ahead, bool), many)
            docs, tags, runs = pack_runs(doc[single], tag[single], at[single], at[single] + length)
            if len(docs):
                yield _batch(_FOUND, docs, np.zeros(len(docs), bool), runs, tags)
            several = pa.array(covered[ahead:] & many)
            part = batch.filter(several)
            if part.num_rows:
                yield _batch(_FOUND, part.column(2), np.zeros(part.num_rows, bool), part.column(4), part.column(5))
            held = (d1[-1], d2[-1], first[-1], 0, 0)

    return run


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text column compressed, for an exchange."""
    schema = docs.schema
    fields = [(f.name if f.name != text else "__packed") for f in schema.fields]
    ddl = ", ".join(f"`{n}` {'binary' if n == '__packed' else f.dataType.simpleString()}" for n, f in zip(fields, schema.fields, strict=True))
    where = schema.fieldNames().index(text)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = pa.array([None if t is None else squeeze.compress(t.encode()) for t in batch.column(where).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs if i == where else c for i, c in enumerate(batch.columns)], fields)

    return docs.mapInArrow(run, ddl)


def unpacked(batches, text: str = "text"):
    """Batches with the text column as it was before packed(), a part of a batch at a time."""
    open_up = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            where = batch.schema.get_field_index("__packed")
            texts = pa.array([None if b is None else open_up.decompress(b).decode() for b in batch.column(where).to_pylist()], pa.large_string())
            names = [text if i == where else n for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([texts if i == where else c for i, c in enumerate(batch.columns)], names)


def text_tag() -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def repeated_runs(docs: DataFrame, kind: str, length: int, seed: int, within: bool = False, lone_words: int = 0) -> DataFrame:
    """docs: columns doc_id (long) and text. One row for each row of docs with a covered window (equal rows have one):
    doc long, tag long (text_tag() of its text), runs array<binary> of [start, end) int32 pairs, in units of the text.

    within: windows that occur earlier in the same document are covered as well. lone_words: a unit of that
    many words or more is a window by itself too.
    Null ids take no part. A document of fewer than `length` units has no window.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag().alias("tag")).where("doc_id is not null")
    rows = plain.mapInArrow(_seed_rows(kind, length, seed, within, lone_words), _ROWS_DDL)
    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "span", "doc")
    found = written(dealt.mapInArrow(_settle_seeds, _FOUND_DDL), "seeds")
    seeds = found.where("seed").groupBy("doc", F.col("tag").alias("__tag")).agg(F.collect_list("runs").alias("runs"))
    texts = packed(plain)
    # a merge join at every size: the list of seeds grows with the corpus, so it is never broadcast
    held = texts.join(seeds.hint("merge"), (texts.doc_id == seeds.doc) & (texts.tag == F.col("__tag"))).select("doc_id", "__packed", "runs", "tag")
    windows = held.mapInArrow(_window_rows(kind, length), _ROWS_DDL)
    dealt = windows.repartition(F.col("key")).sortWithinPartitions("key", "span", "doc")
    more = dealt.mapInArrow(_settle_windows(length), _FOUND_DDL)
    return found.where("not seed").union(more).groupBy("doc", "tag").agg(F.collect_list("runs").alias("runs"))
