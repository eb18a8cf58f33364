"""Vectorised kernels over Arrow text columns: units (words or lines), hashes, sequence digests.

Units are told apart by their bytes: coded() numbers the distinct ones of a chunk through Arrow's
dictionary encoding, and what leaves a chunk is named by a keyed BLAKE2 digest of 128 bits, as two
independent halves. unit_hashes() is a fast hash that may only propose. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import CHUNK_BYTES

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240131))
TABLE = _random.integers(0, 2**64, 256, dtype=U)
BASES = [U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0xA0761D6478BD642F)]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}
_KEYED = hashlib.blake2b(digest_size=16, key=b"tessera units")


def powers(n: int, which: int = 0) -> np.ndarray:
    """BASES[which] ** (0 .. at least n-1)."""
    if which not in _powers or len(_powers[which]) < n:
        full = np.full(max(n, 4096), BASES[which])
        full[0] = 1
        _powers[which] = np.cumprod(full, dtype=U)
    return _powers[which]


def inverse_powers(n: int, which: int) -> np.ndarray:
    key = which + 100
    if key not in _powers or len(_powers[key]) < n:
        full = np.full(max(n, 4096), U(pow(int(BASES[which]), -1, 2**64)))
        full[0] = 1
        _powers[key] = np.cumprod(full, dtype=U)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about `limit` bytes of text: (batch, bytes, offsets of the texts; null is empty)."""
    try:
        yield from _cut(batches, text, limit)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live from task to task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _cut(batches, text: str, limit: int):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = pc.fill_null(column, "")
        if pa.types.is_large_string(column.type) is False:
            column = column.cast(pa.large_string())
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            part = offsets[at : to + 1]
            yield batch.slice(at, to - at), raw[part[0] : part[-1]], part - part[0]
            at = to


def spans_of(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-separators within each text: byte starts, byte ends, and how many units
    come before each text (one entry more than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""The \n-split lines of each text, the empty ones too: an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def holds_word(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each line of lines_of() holds a word."""
    out = np.zeros(len(starts), bool)
    full = np.flatnonzero(ends > starts)
    if len(full):
        # from each line to the next: line breaks between them are separators and change nothing
        out[full] = np.logical_or.reduceat(~SPACES[raw[: ends[full[-1]]]], starts[full])
    return out


def unit_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span, by slices of bounded size. Spans may be empty, not overlap."""
    out = np.zeros(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        s, e = starts[at:to], ends[at:to]
        length = e - s
        full = length > 0
        if full.any():
            fs, fl = s[full], length[full]
            ends_at = np.cumsum(fl)
            begins = ends_at - fl
            inner = np.arange(ends_at[-1]) - np.repeat(begins, fl)
            octets = raw[inner + np.repeat(fs, fl)]
            if fold is not None:
                octets = fold[octets]
            value = TABLE[octets] * powers(int(fl.max()))[inner]
            out[at:to][full] = np.add.reduceat(value, begins)
        out[at:to] += length.astype(U) * U(0xC2B2AE3D27D4EB4F)
        at = to
    return mix(out)


def coded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each byte span among the distinct ones, and those. Spans are ascending, apart and not empty."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    if offsets[-1] == ends[-1] - starts[0]:
        data = raw[starts[0] : ends[-1]]
    else:
        step = np.zeros(len(raw) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        data = raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    units = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = units.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), _rows(found.dictionary)


def _rows(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls; several times faster than to_pylist()."""
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def digests(rows: list[bytes]) -> np.ndarray:
    """Two 64-bit halves (columns) of each row's keyed BLAKE2 digest."""
    out = []
    for r in rows:
        one = _KEYED.copy()  # the key's block is hashed once
        one.update(r)
        out.append(one.digest())
    return np.frombuffer(b"".join(out), U).reshape(-1, 2)


def named(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both digest halves of each span."""
    codes, rows = coded(raw, starts, ends)
    halves = digests(rows)
    return halves[codes, 0], halves[codes, 1]


def slots_of(rows: list[bytes]) -> np.ndarray:
    """A fast 64-bit hash of each distinct unit, for features that are hashed anyway."""
    size = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(size)
    return unit_hashes(np.frombuffer(b"".join(rows), np.uint8), ends - size, ends)


def groups_of(*columns: np.ndarray) -> np.ndarray:
    """The number of each row of non-negative integer columns among the distinct rows: exact, by packing
    as many columns into a word as fit."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = int(c.max()) + 1 if len(c) else 1
        if int(out.max(initial=0)) >= (2**62) // width:
            out = np.unique(out, return_inverse=True)[1]
        out = out * width + c
    return np.unique(out, return_inverse=True)[1]


def fixed_digest(hashes: np.ndarray, length: int, which: int) -> np.ndarray:
    """Digest of the `length` hashes from each position on; positions too near the end are left out."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(length):
        out = out * BASES[which] + hashes[j : j + n]
    return mix(out)


def ranged_digest(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Digest of hashes[start:end] for many ranges at once, by prefix sums."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(hashes)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * powers(n, which)[:n], dtype=U, out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse_powers(n, which)[starts]
    return mix(value + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))


def counts_by_text(positions_before: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over [before[i], before[i+1]), empty ranges as 0."""
    out = np.zeros(len(positions_before) - 1, np.int64)
    full = np.flatnonzero(positions_before[1:] > positions_before[:-1])
    if len(full):
        values = values[: positions_before[-1]]
        out[full] = np.add.reduceat(values.view(np.uint8) if values.dtype == bool else values, positions_before[full], dtype=np.int64)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, as disjoint ranges in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return starts[first], ends[last]


def ranges_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
