"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import pickle
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Bytes of text encoded at once, tokens rendered at once, and pre-tokens that a worker remembers.
CHUNK, BLOCK, MEMO = 1 << 20, 1 << 18, 300_000
#: The one pattern that pieces() implements. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, WHITE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    where = np.array(points)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            out[where[m.start() : m.end()]] = kind
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte starts of the matches of PATTERN in each text (UTF-8). Each byte belongs to a match.

    A match is a run of one class, with a plain space before it if there is one. Of a run of white
    space before other text, the last character is split off; at the end of a text it isn't. An
    apostrophe that begins a match takes one of its endings with it.
    """
    n = len(raw)
    kind = classes[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b0, size = raw[lead].astype(np.int64), 1 + (raw[lead] >= 0xC0).astype(np.int64) + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        point = b0 & np.array([0, 0, 31, 15, 7])[size]
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (raw[lead[more] + k] & 63)
        found = classes[point]
        kind[lead] = found
        for k in (1, 2, 3):
            more = size > k
            kind[lead[more] + k] = found[more]
    edge = np.zeros(n + 4, bool)
    edge[offsets] = True
    fresh = edge[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    cut = fresh.copy()
    at = np.flatnonzero(fresh & (kind != WHITE) & ~edge[:n])  # runs with something of the text before them
    at = at[kind[at - 1] == WHITE]
    last = at - 1
    for _ in range(3):
        last = np.where(raw[last] & 0xC0 == 0x80, last - 1, last)
    cut[last] = True
    cut[at[raw[last] == 32]] = False
    mark = np.flatnonzero(cut & (raw == 39))
    mark = mark[kind[mark] == OTHER]
    if len(mark):
        wide = np.zeros(n + 4, np.uint8)
        wide[:n] = raw
        one, two = wide[mark + 1], wide[mark + 2]
        near, far = ~edge[mark + 1], ~edge[mark + 1] & ~edge[mark + 2]
        short = near & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = far & ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108))
        room = np.zeros(n + 4, bool)
        room[:n] = cut
        room[mark[short | long] + 1] = False
        room[mark[short] + 2] = True
        room[mark[long] + 3] = True
        cut = room[:n]
    return np.flatnonzero(cut)


class PerfectHash:
    """Hash and displace: keys fall into buckets, each bucket has the first displacement that sends
    its keys to free slots; as many slots as keys. A slot keeps its key's 64-bit hash for refusal."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        self.buckets = max(1, n // 3)
        bucket = (hashes % tk.U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable").tolist():
            keys = order[edges[b] : edges[b + 1]]
            if not len(keys):
                break
            at, step = 0, 64
            while True:
                tries = np.arange(at, at + step, dtype=tk.U)
                slots = self.slots(hashes[keys][None, :], tries[:, None])
                fits = free[slots].all(1)
                if len(keys) > 1:
                    rows = np.sort(slots, 1)
                    fits &= (rows[:, 1:] != rows[:, :-1]).all(1)
                if fits.any():
                    k = int(fits.argmax())
                    self.shift[b] = at + k
                    self.key_at[slots[k]] = keys
                    free[slots[k]] = False
                    break
                at, step = at + step, min(step * 4, 65_536)
        self.hash_at = hashes[self.key_at]

    def slots(self, hashes, shift):
        return (tk.mix(hashes + shift * tk.BASES[1]) % tk.U(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no key has the hash."""
        slot = self.slots(hashes, self.shift[(hashes % tk.U(self.buckets)).astype(np.int64)].astype(tk.U))
        return np.where(self.hash_at[slot] == hashes, self.key_at[slot], -1)


class Tokenizer:
    """Encodes texts chunk by chunk. Each distinct pre-token of a chunk is resolved once: from those seen
    before, by the perfect hash (and its bytes) if it is a token itself, else by merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.classes = character_classes()
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        self.perfect = PerfectHash(self.hashes_of(self.tokens))
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        # merges by ids: a pair whose bytes together are a token
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        by_id = {i: t for t, i in ranks.items()}
        every = range(max(by_id) + 1)
        self.as_bytes = self._table([by_id.get(i, b"") for i in every])
        self.as_text = self._table([b"%d," % i for i in every])
        self.forget()

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def hashes_of(rows: list[bytes]) -> np.ndarray:
        return tk.digests(rows)[:, 0]

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}  # pre-tokens by their bytes, numbered
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # where the ids of each are
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def merged(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left: a heap of
        rank and place over ids linked both ways."""
        pair = self.pair.get
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        ids.append(-1)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or pair(ids[i] << 32 | ids[j]) != rank:
                continue  # a side has changed since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := pair(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def learn(self, rows: list[bytes]) -> None:
        """Remember the encodings of new pre-tokens, behind those known."""
        flat, count = [], []
        for at, row in zip(self.perfect.find(self.hashes_of(rows)).tolist(), rows, strict=True):
            ids = [int(self.ids[at])] if at >= 0 and self.tokens[at] == row else self.merged(row)
            flat += ids
            count.append(len(ids))
        known, now = len(self.seen), len(self.seen) + len(rows)
        self.seen.update(zip(rows, range(known, now), strict=True))
        if now > len(self.count):
            self.begin, self.count = (np.concatenate([x, np.zeros(now, np.int64)]) for x in (self.begin, self.count))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), np.int32)])
        self.count[known:now] = count
        self.begin[known:now] = self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many come before each text. Pre-tokens are told apart by their bytes."""
        starts = pieces(raw, offsets, self.classes)
        which, rows = tk.coded(raw, starts, np.append(starts[1:], len(raw)))
        if len(self.seen) > MEMO:
            self.forget()
        new = [r for r in rows if r not in self.seen]
        if new:
            self.learn(new)
        at = np.array([self.seen[r] for r in rows], np.int64)[which]
        ids = _gather(self.flat, self.begin[at], size := self.count[at])
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        data, begin, size = self.as_bytes
        return _gather(data, begin[ids], size[ids]).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """Each id in decimal digits, with a comma after it."""
        data, begin, size = self.as_text
        return _gather(data, begin[ids], size[ids]).tobytes()


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[begin : begin + size] of every pair, one after another."""
    if not len(size):
        return data[:0]
    ends = np.cumsum(size)
    return data[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]


def encoded_chunk(tokenizer: Tokenizer, raw: np.ndarray, offsets: np.ndarray):
    """ids, counts before each text, decoded bytes, checked to be the input's."""
    ids, before = tokenizer.encode(raw, offsets)
    decoded = b"".join(tokenizer.decode(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK))
    if decoded != raw.tobytes():
        raise AssertionError("the decoded bytes differ from the text")
    return ids, before, decoded


_OPEN: dict[str, Tokenizer] = {}


def _opened(name: str, image: bytes) -> Tokenizer:
    """The tokenizer of this worker, which keeps one: later queries with the same tables share it."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = pickle.loads(image)
    return _OPEN[name]


_SHIPPED: dict[tuple, object] = {}


def shipped(context, ranks_path: str):
    """The broadcast of (name, pickled tokenizer), built once for a context and file: the tables have the vocabulary's size."""
    key = (context.applicationId, ranks_path, os.path.getmtime(ranks_path))
    if key not in _SHIPPED:
        _SHIPPED.clear()
        image = pickle.dumps(Tokenizer(load_ranks(ranks_path)), protocol=5)
        _SHIPPED[key] = context.broadcast((hashlib.sha256(image).hexdigest(), image))
        tk.give_back()
    return _SHIPPED[key]


def tokenized(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, digests: bool = True) -> DataFrame:
    """Encode each whole text and decode the ids. One row for each row of docs: doc_id and n_tokens, then
    with digests ids_sha256 and decoded_sha256, else ids array<int> and decoded binary.

    ranks_path is read on the driver, which ships the tables (their size is the vocabulary's). Null or
    empty text: no ids. Other columns are ignored; null and repeated doc_id return as they are.
    """
    if pattern != PATTERN:
        raise ValueError("only PATTERN is implemented")
    tables = shipped(docs.sparkSession.sparkContext, ranks_path)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        tokenizer = _opened(*tables.value)
        for batch, raw, offsets in tk.chunks(batches, limit=CHUNK):
            ids, before, decoded = encoded_chunk(tokenizer, raw, offsets)
            marks, counts = list(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)), pa.array(np.diff(before), pa.int64())
            ends = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            if digests:
                names, one = [], []
                for (a, b), (x, y) in zip(marks, ends, strict=True):
                    digest = hashlib.sha256()
                    for at in range(a, b, BLOCK):
                        line = tokenizer.decimals(ids[at : min(at + BLOCK, b)])
                        digest.update(line if at + BLOCK < b else line[:-1])
                    names.append(digest.hexdigest())
                    one.append(hashlib.sha256(decoded[x:y]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(names, pa.string()), pa.array(one, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, lists, pa.array([decoded[x:y] for x, y in ends], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return plain.mapInArrow(run, f"doc_id long, n_tokens long, {tail}")
