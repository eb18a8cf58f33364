"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints at 3 or fewer differing bits, cut into two halves, differ by at most one bit in one
half. That half with the differing bit left out is equal in both, so an equality on (half, bit left
out, the other 31 bits) finds every such pair; the full distance is then checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .components import components
from .runtime import written

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42
BLOCK = 2048
#: A key of more distinct fingerprints than MANY is cut by the other half's bytes in the kernel; keys that hold
#: over a HOT_KEYS-th of a sample's index rows (and HOT_LEAST of them) are cut before the exchange.
MANY, HOT_KEYS, HOT_LEAST, SAMPLE = 2048, 4000, 32, 64
SLICE = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INDEX = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text; of one without words, 0."""
    starts, ends, before = tk.spans_of(raw, offsets)
    out = np.zeros(len(offsets) - 1, tk.U)
    if not len(starts):
        return out
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1  # where each word begins once all are joined by one space
    total = int(at[-1] + length[-1])
    joined = np.full(total + 1, 32, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = _LOWER[raw[inside]]
    data = joined.tobytes()
    count = np.diff(before)
    n = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    first = np.repeat(before[:-1], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + shingle, np.repeat(before[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(data[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + length[last]).tolist(), strict=True)], tk.U, len(first))
    full = n > 0
    out[full] = majority(h, n[full])
    return out


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each of the runs of n hashes (none empty), the bits set in over half."""
    out = np.zeros(len(n), tk.U)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):  # slices of a bounded number of unpacked bits, but for a single long text
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        begin = int(ends[at] - n[at])
        bits = np.unpackbits(h[begin : ends[to - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, ends[at:to] - n[at:to] - begin, axis=0, dtype=np.int32)
        out[at:to] = np.packbits(votes * 2 > n[at:to, None], axis=1, bitorder="little").view(tk.U).ravel()
        at = to
    return out


def _fingerprint_batches(batches):
    for batch, raw, offsets in tk.chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fingerprints_of(raw, offsets).view(np.int64))], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id long, text_key long (a hash of the text), fp long (the 64 bits as a signed number) for each row of docs."""
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    return plain.mapInArrow(_fingerprint_batches, "doc_id long, text_key long, fp long")


def variants_of(fps: np.ndarray) -> np.ndarray:
    """Index keys, 64 for each fingerprint: a half with one bit left out, and which half and bit. The lowest bit
    of a key is 1 if the half is the upper one."""
    fps = fps.view(tk.U)[:, None]
    bit = np.arange(32, dtype=tk.U)
    low, high = fps & tk.U(0xFFFFFFFF), fps >> tk.U(32)
    keys = [half & ~(tk.U(1) << bit) | (bit << tk.U(32)) | tk.U(which << 37) for which, half in enumerate((low, high))]
    return np.concatenate([tk.mix(k) & ~tk.U(1) | tk.U(which) for which, k in enumerate(keys)], 1)


def _index_batches(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(variants_of(part).ravel().view(np.int64)), pa.array(np.repeat(part, 64))], schema=_INDEX)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(tk.U))


def forest_of(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints under `distance`, n-1 at most. Each
    step takes one member off the frontier and the rest in blocks, so memory stays linear."""
    left, out = fps, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.concatenate([_distance(left[i : i + BLOCK * 64], at) <= distance for i in range(0, len(left), BLOCK * 64)])
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                frontier += found.tolist()
                left = left[~near]
    return out


def links_of(key: int, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """forest_of() for the fingerprints of one key. They agree in its half but for a bit, so of those at `distance` or
    fewer, 3 at most, one of the other half's four bytes is equal too: many are compared byte by byte."""
    if len(fps) <= MANY:
        return forest_of(fps, distance)
    shift, out = 0 if key & 1 else 32, []
    for part in range(4):
        octet = (fps >> np.int64(shift + 8 * part)) & np.int64(255)
        order = np.argsort(octet, kind="stable")
        cuts = np.searchsorted(octet[order], np.arange(257))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                out += forest_of(fps[order[a:b]], distance)
    return out


def _link_batches(distance: int):
    """Rows sorted by (key, sub, fp): verified links within each group, as forests."""

    def links(key, sub, fp):
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])))
        size = np.diff(np.append(at, len(key)))
        pairs = []
        for n in np.unique(size[size > 1]):
            begin = at[size == n]
            if n == 2:
                a, b = fp[begin], fp[begin + 1]
                near = _distance(a, b) <= distance
                pairs.append(np.stack([a[near], b[near]], 1))
            else:
                for x in begin:
                    if f := links_of(int(key[x]), fp[x : x + n], distance):
                        pairs.append(np.array(f, np.int64))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)

    def given(held):
        found = links(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else ()
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_PAIR)

    def run(batches):
        held = []  # pieces; the group that a batch ends with is carried on, joined once it is whole
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0])):
                held.append([c[:cut] for c in rows])
                yield from given([h for h in held if len(h[0])])
                held = []
            held.append([c[cut:] for c in rows])
        yield from given(held)

    return run


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """distinct: one column fp, no repeats. Links u, v whose components are those of all pairs at
    `distance` or fewer differing bits.

    A hot key is one that holds many rows of a sample of a SAMPLE-th of the fingerprints; its rows are dealt by
    the four bytes of the other half, one of which near fingerprints share. Any choice of hot keys gives the same
    components; HOT_KEYS of them at most are broadcast.
    """
    if distance > 3:
        raise ValueError("two segments with one wildcard bit cover distances up to 3")
    index = distinct.select("fp").mapInArrow(_index_batches, "key long, fp long")
    sample = distinct.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(SAMPLE)) == 0)
    rows = sample.count() * 64
    hot = sample.mapInArrow(_index_batches, "key long, fp long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_LEAST, rows // HOT_KEYS)).select("key", F.lit(True).alias("hot"))
    shift = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 0).otherwise(32)
    octets = F.array(*[F.expr(f"CAST(shiftrightunsigned(fp, shift + {8 * p}) & 255 AS int) + {p << 8}") for p in range(4)])
    dealt = index.join(F.broadcast(hot), "key", "left").withColumn("shift", shift).select("key", F.explode(F.when(F.col("hot"), octets).otherwise(F.array(F.lit(-1)))).alias("sub"), "fp")
    dealt = dealt.repartition(F.col("key"), F.col("sub")).sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_link_batches(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id long, fingerprint string (16 hex digits), component_id long (the smallest doc_id that
    links reach, itself included), text_key long (a hash of the text), one row for each row of docs.

    Null and empty texts have the fingerprint 0 and link like any other. Rows with a null doc_id
    link too; a component with no other id has a null component_id. Repeated rows return as often.
    Extra columns are ignored. Equal fingerprints are one node from the start, so copies cost a row
    of aggregation each and make no pairs.
    """
    own = written(fingerprints(docs), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(fingerprint_links(nodes, distance)).select(F.col("node").alias("fp"), "component")
    known = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key")


def _without(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows, told apart by doc_id and text, whose component has a smaller doc_id."""
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    own = F.xxhash64(F.coalesce(docs.text.cast("string"), F.lit("")))
    return docs.join(gone.hint("merge"), (docs.doc_id.cast("long") == F.col("__gone")) & (own == F.col("__text")), "left_anti")


def dedup_near(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows with a null doc_id stay.
    Of rows that repeat the staying doc_id, those of its component stay."""
    return _without(docs, near_duplicates(docs.where("doc_id is not null"), distance))


# Similar texts: the same signatures over wider fingerprints, for a similarity of five-word shingles.

#: The index cuts 126 bits of a fingerprint of two-word shingles, which edits move less, into SEGMENTS of SEGMENT_BITS.
#: What it proposes is held against 128 bits of a fingerprint of five-word shingles, of which at most SIMILAR_BITS differ, and then
#: decided by the texts themselves: the Jaccard similarity of their sets of five-word shingles is SIMILARITY per cent or more.
SEGMENTS, SEGMENT_BITS, SIMILAR_BITS = 6, 21, 36
INDEX_WORDS, SIMILAR_WORDS, SIMILARITY = 2, 5, 80
#: Rows that all parts of a hot key share; links to so many of the nearest of its key that each row proposes besides the spanning ones; the
#: largest group that is compared as one matrix.
HUBS, NEAREST, MATRIX = 64, 3, 256
#: Rows of a hot key that meet in one task once all are compared, or twice as many, and how many are held against MATRIX others at once.
TILE, COLUMNS = 1 << 15, 2048


def wide_fingerprints_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four columns of 64 bits for each text: 128 bits over its distinct two-word shingles, 128 over the five-word ones. Letters A-Z
    are lowered; no words: 0."""
    return _wide_of(raw, offsets)[0]


def _wide_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """wide_fingerprints_of() and the number of distinct five-word shingles, as _shingle_sets() has them."""
    raw = _LOWER[raw]
    out, sizes = np.zeros((len(offsets) - 1, 4), tk.U), np.zeros(len(offsets) - 1, np.int32)
    starts, ends, before = tk.spans_of(raw, offsets)
    if not len(starts):
        return out, sizes
    halves = tk.named(raw, starts, ends)
    for k, (half, size) in enumerate((h, n) for n in (INDEX_WORDS, SIMILAR_WORDS) for h in halves):
        full, grams, n = _distinct_grams(half, before, size, k % 2)
        out[full, k] = majority(grams, n)
        if k == 2:
            sizes[full] = n
    return out, sizes


def _distinct_grams(half: np.ndarray, before: np.ndarray, size: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a word, digests of their distinct shingles, ascending in each text, and how many each has. A shingle counts once however
    often it stands there, so that a separator or a number that repeats doesn't outweigh the rest. Fewer words: the whole sequence."""
    count = np.diff(before)
    full = np.flatnonzero(count)
    n = np.maximum(count[full] - size + 1, 1)
    first = np.repeat(before[full], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    grams = tk.fixed_digest(half, size, which)
    few = count[full] < size  # their one shingle is the whole sequence
    h = grams[np.minimum(first, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(first), tk.U)
    h[(np.cumsum(n) - n)[few]] = tk.ranged_digest(half, before[full][few], before[full + 1][few], 2)
    text = np.repeat(np.arange(len(full)), n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return full, h[fresh], np.bincount(text[fresh], minlength=len(full))


def _wide_batches(batches):
    for batch, raw, offsets in tk.chunks(batches):
        f, sizes = _wide_of(raw, offsets)
        f = f.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(4)), pa.array(sizes)], ["doc_id", "text_key", "a", "b", "c", "d", "grams"])


def _shingle_sets(batches):
    """nid and the digests of the distinct five-word shingles of its text."""
    for batch, raw, offsets in tk.chunks(batches):
        raw = _LOWER[raw]
        starts, ends, before = tk.spans_of(raw, offsets)
        sizes, grams = np.zeros(len(offsets) - 1, np.int64), np.zeros(0, tk.U)
        if len(starts):
            full, grams, n = _distinct_grams(tk.named(raw, starts, ends)[0], before, SIMILAR_WORDS, 0)
            sizes[full] = n
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(grams.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["nid", "shingles"])


def _wide_index(batches):
    """SEGMENTS x SEGMENT_BITS rows for each fingerprint: a segment with one bit left out, its number and the bit's. Columns behind the first five come along."""
    bit = np.arange(SEGMENT_BITS, dtype=tk.U)
    mask = tk.U((1 << SEGMENT_BITS) - 1)
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            a, b, c, d, ident, *more = (x.to_numpy() for x in batch.columns)
            keys = []
            for word, word_of in enumerate((a, b)):
                for s in range(SEGMENTS // 2):
                    segment = (word_of.view(tk.U) >> tk.U(s * SEGMENT_BITS)) & mask
                    left = segment[:, None] & ~(tk.U(1) << bit)
                    # without the left-out bit the lower part stays and the upper part moves down
                    low = left & ((tk.U(1) << bit) - tk.U(1))
                    rest = low | (left >> (bit + tk.U(1))) << bit
                    keys.append(rest | bit << tk.U(20) | tk.U((word * SEGMENTS // 2 + s) << 25))
            n = SEGMENTS * SEGMENT_BITS
            key = np.concatenate(keys, 1).ravel().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(x, n)) for x in (ident, c, d, *more))], ["key", "id", "c", "d", *batch.schema.names[5:]])
    tk.give_back()


def near_links(ident: np.ndarray, c: np.ndarray, d: np.ndarray, bits: int) -> np.ndarray:
    """Links of a group by two-word fingerprints: a forest of least distances under `bits` bits, and from each row those to its NEAREST
    nearest. A row of ids each; memory is linear in the group, or MATRIX squared."""
    if len(ident) <= MATRIX:
        apart = (_distance(c[:, None], c[None, :]) + _distance(d[:, None], d[None, :])).astype(np.int16)
        np.fill_diagonal(apart, 255)
        some = np.flatnonzero((apart <= bits).any(1))
        ident, apart = ident[some], apart[np.ix_(some, some)]
        row_of = apart.__getitem__
    else:

        def row_of(at):
            row = (_distance(c, c[at]) + _distance(d, d[at])).astype(np.int16)
            row[at] = 255
            return row

    out, n = [], len(ident)
    if not n:
        return np.zeros((0, 2), np.int64)
    least, parent = np.full(n, 255, np.int16), np.zeros(n, np.int64)
    left, at = np.ones(n, bool), 0
    for _ in range(n):
        left[at] = False
        row = row_of(at)
        close = np.argpartition(row, NEAREST - 1)[:NEAREST] if n > NEAREST else np.arange(n)
        out += [(at, x) for x in close[row[close] <= bits].tolist()]
        nearer = left & (row < least)
        least[nearer], parent[nearer] = row[nearer], at
        at = int(np.where(left, least, 256).argmin())
        if left[at] and least[at] <= bits:
            out.append((int(parent[at]), at))
    return ident[np.array(out, np.int64).reshape(-1, 2)]


def _wide_links(bits: int):
    """Rows sorted by (key, sub, id): links of each group, whose rows are at most MANY or a sub's share of a hot key."""

    def links(key, sub, ident, c, d):
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])))
        size = np.diff(np.append(at, len(key)))
        two = at[size == 2]
        near = _distance(c[two], c[two + 1]) + _distance(d[two], d[two + 1]) <= bits
        pairs = [np.stack([ident[two[near]], ident[two[near] + 1]], 1)]
        for x, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            pairs.append(near_links(ident[x : x + n], c[x : x + n], d[x : x + n], bits))
        return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)

    def given(held):
        if held:
            found = links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_PAIR)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [x.to_numpy() for x in batch.columns]
            cut = int(np.argmax((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])))
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0])):
                held.append([x[:cut] for x in rows])
                yield from given([h for h in held if len(h[0])])
                held = []
            held.append([x[cut:] for x in rows])
        yield from given(held)
        tk.give_back()

    return run


def crossing_pairs(ident, c, d, component, grams, part, bits: int, similarity: int):
    """Arrays u, v of all pairs of a group, or of its two parts, that are of two components, differ in at most `bits` bits and have numbers of shingles that
    allow the similarity. Rows stand by part. Memory is MATRIX times COLUMNS."""
    n = len(ident)
    cut = int(np.argmax(part != part[0]))  # 0: one part
    for a in range(0, cut or n, MATRIX):
        rows = slice(a, min(a + MATRIX, cut or n))
        for b in range(cut or a, n, COLUMNS):
            cols = slice(b, b + COLUMNS)
            near = _distance(c[rows, None], c[None, cols]) + _distance(d[rows, None], d[None, cols]) <= bits
            near &= component[rows, None] != component[None, cols]
            i, j = (x + at for x, at in zip(np.nonzero(near), (a, b), strict=True))
            good = np.minimum(grams[i], grams[j]) * 100 >= similarity * np.maximum(grams[i], grams[j])
            good &= (i < j) | (cut > 0)
            if good.any():
                yield ident[i[good]], ident[j[good]]


def _crossing(bits: int, similarity: int):
    """Rows (key, sub, part, id, c, d, component, grams) sorted by key, sub and part: crossing_pairs() of each group."""

    def given(held):
        if not held:
            return
        key, sub, part, ident, c, d, component, grams = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(key):
            return
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])))
        mixed = np.minimum.reduceat(component, at) != np.maximum.reduceat(component, at)
        end = np.append(at[1:], len(key))
        found, n = [], 0
        for x, y in zip(at[mixed].tolist(), end[mixed].tolist(), strict=True):
            for u, v in crossing_pairs(*(z[x:y] for z in (ident, c, d, component, grams, part)), bits, similarity):
                found.append((np.minimum(u, v), np.maximum(u, v)))
                n += len(u)
                if n > SLICE:
                    yield from batch_of(found)
                    found, n = [], 0
        yield from batch_of(found)

    def batch_of(found):
        if found:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [x.to_numpy() for x in batch.columns]
            rows[7] = rows[7].astype(np.int64)
            cut = int(np.argmax((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])))
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0])):
                held.append([x[:cut] for x in rows])
                yield from given(held)
                held = []
            held.append([x[cut:] for x in rows])
        yield from given(held)
        tk.give_back()

    return run


def crossing_links(nodes: DataFrame, labels: DataFrame, proposed: DataFrame, bits: int = SIMILAR_BITS, similarity: int = SIMILARITY) -> DataFrame:
    """What similar_links() left out: all pairs u < v of ids that an index key brings together, differ in at most `bits` bits and belong to two of the components
    that labels (node, component) name, without those that were proposed. nodes: a, b, c, d, id and grams, the number of distinct five-word shingles.

    A row that was not proposed has no near one under a key that is not hot, since near_links() proposes the nearest. Rows of a hot key are dealt in parts of TILE,
    and each pair of parts meets in a task of its own, so that a task holds two of them and none is left out; rows sent grow with the square of such a key's parts.
    """
    carried = ["id", "c", "d", "component", "grams"]
    named = nodes.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("a", "b", "c", "d", "id", F.coalesce("component", "id").alias("component"), "grams")
    named = written(named, "named_nodes")
    indexed = lambda rows: rows.select("a", "b", "c", "d", "id", "component", "grams").mapInArrow(_wide_index, "key int, id long, c long, d long, component long, grams int")
    hot = written(_hot_keys(nodes)[1].select("key", F.ceil(F.col("n") * SAMPLE / TILE).cast("int").alias("parts")), "hot_keys")
    ends = proposed.select(F.col("u").alias("id")).union(proposed.select("v")).distinct()
    dealt = indexed(named.join(ends, "id", "left_semi")).join(F.broadcast(hot), "key", "left_anti").select("key", F.lit(-1).alias("sub"), F.lit(0).alias("part"), *carried)
    if not hot.isEmpty():
        own = indexed(named).join(F.broadcast(hot), "key").withColumn("part", F.pmod(F.xxhash64("id", F.lit(SEED + 3)), F.col("parts")).cast("int"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least("part", x) * F.col("parts") + F.greatest("part", x))
        dealt = dealt.unionByName(own.select("key", F.explode(tiles).alias("sub"), "part", *carried))
    dealt = dealt.repartition(F.col("key"), F.col("sub")).sortWithinPartitions("key", "sub", "part")
    return dealt.mapInArrow(_crossing(bits, similarity), "u long, v long").distinct().join(proposed, ["u", "v"], "left_anti")


def _hot_keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows of a SAMPLE-th of the nodes, and the keys that hold many of them with their numbers n, HOT_KEYS at most."""
    picked = nodes.select("a", "b", "c", "d", "id").where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(SAMPLE)) == 0)
    sample = written(picked.mapInArrow(_wide_index, "key int, id long, c long, d long"), "sample")
    least = max(HOT_LEAST, sample.count() // HOT_KEYS)
    return sample, sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least)


def similar_links(nodes: DataFrame, bits: int = SIMILAR_BITS) -> DataFrame:
    """nodes: a, b, c, d (a fingerprint) and id. Links u < v of ids whose five-word fingerprints differ in at most
    `bits` bits and whose two-word ones have a segment that differs in at most one: near_links() of each index key, not all pairs.

    A hot key, one that holds many rows of a sample, is dealt in parts by id, each with the same HUBS sampled rows of
    the key, so that its parts hang together; HOT_KEYS of them at most are broadcast. Rows of different parts meet at the
    hubs and by their other keys only; crossing_links() compares what is then left in two components.
    """
    ddl = "key int, id long, c long, d long"
    fields = ["a", "b", "c", "d", "id"]
    index = nodes.select(*fields).mapInArrow(_wide_index, ddl)
    sample, many = _hot_keys(nodes)
    parts = F.ceil(F.col("n") * SAMPLE / MANY).cast("int")
    hot = written(many.select("key", parts.alias("parts")), "hot_keys")
    order = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id")
    hubs = sample.join(F.broadcast(hot), "key").withColumn("place", F.row_number().over(order)).where(F.col("place") <= HUBS)
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), "id", "c", "d")
    sub = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("id", F.lit(SEED + 2)), F.col("parts")).cast("int"))
    dealt = index.join(F.broadcast(hot), "key", "left").select("key", sub.alias("sub"), "id", "c", "d").unionByName(hubs)
    dealt = dealt.repartition(F.col("key"), F.col("sub")).sortWithinPartitions("key", "sub", "id")
    return dealt.mapInArrow(_wide_links(bits), "u long, v long").where("u <> v").distinct()


def verified_links(links: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of links (u, v) those whose texts have `similarity` per cent of their five-word shingles in common, counted on the sets themselves (of 64-bit digests).
    nodes: id, doc_id, text_key, one row of texts (doc_id, text, text_key) each. Only texts that a link names move."""
    links = written(links, "links")
    ends = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    named = nodes.join(ends, "id").select("id", F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"))
    rows = texts.join(named.hint("merge"), (texts.doc_id == F.col("__d")) & (texts.text_key == F.col("__k"))).select(F.col("id").alias("nid"), "text")
    sets = written(rows.mapInArrow(_shingle_sets, "nid long, shingles array<long>").dropDuplicates(["nid"]), "shingle_sets")
    side = lambda end: sets.select(F.col("nid").alias(end), F.col("shingles").alias(f"s{end}"))
    both = links.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common * 100 >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")


def similar_groups(docs: DataFrame, bits: int = SIMILAR_BITS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text, which tells rows of a repeated doc_id apart), component_id (the smallest doc_id that links reach,
    itself included), one row for each row of docs with a doc_id. Links: verified_links() of similar_links(), so no two texts are joined but by a chain of texts
    that are similar indeed; equal fingerprints are one node from the start. Pairs of two components are then all compared (crossing_links()), so the groups are those of
    all pairs that share an index key. Texts without words are alike; null counts as empty. An edit to each of the segments hides a pair: measured recall is in the README."""
    text = F.col("text").cast("string")
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    own = written(plain.mapInArrow(_wide_batches, "doc_id long, text_key long, a long, b long, c long, d long, grams int"), "wide")
    print4 = ["a", "b", "c", "d"]
    nodes = own.groupBy(*print4).agg(F.min(F.struct("doc_id", "text_key", "grams")).alias("r")).select(*print4, F.xxhash64(*print4, F.lit(SEED)).alias("id"), "r.doc_id", "r.text_key", "r.grams")
    nodes = written(nodes, "wide_nodes")
    proposed = written(similar_links(nodes, bits), "proposed")
    good = written(verified_links(proposed, nodes, plain, similarity), "verified")
    labels = components(good)
    left = written(verified_links(crossing_links(nodes, labels, proposed, bits, similarity), nodes, plain, similarity), "crossing")
    if not left.isEmpty():
        labels = components(good.union(left))
    named = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(*print4, "doc_id", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(least, "component").drop("component")
    return own.join(named, print4).select("doc_id", "text_key", "component_id")


def dedup_similar(docs: DataFrame, bits: int = SIMILAR_BITS) -> DataFrame:
    """docs without the rows whose similar_groups() component has a smaller doc_id; rows with a null doc_id stay, and
    so do all rows of a repeated doc_id that are in its component. A row goes for its own text, never for that of another row of its doc_id."""
    return _without(docs, similar_groups(docs, bits))
