"""Quality rules: base counts, then a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .docstats import counts
from .labelled import training_rows
from .runtime import release, tables_written, written

#: Rows trained on, and slots that have a weight: the matrix on the driver is of that size for texts of any number and length.
TRAIN_ROWS, FEATURES = 5_000, 4_096
BITS = 18
STEPS, RATE, L2, LEAST_ROWS = 60, 0.5, 1e-6, 3
THRESHOLD = 0.3
LEAST_WORDS = 50
BLOCKS = 3  # single words, pairs of words, four characters
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hashed(raw: np.ndarray, offsets: np.ndarray, words: tuple):
    """For each block of features: slots in [0, 2**BITS), and how many come before each text."""
    hashes, text, before = words
    shift = tk.U(64 - BITS)
    yield (hashes >> shift).astype(np.int32), before
    pairs = tk.fixed_digest(hashes, 2, 0) >> shift if len(hashes) > 1 else np.zeros(0, tk.U)
    same = text[:-1] == text[1:]
    kept = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(same, out=kept[1 : len(same) + 1])
    kept[len(same) + 1 :] = kept[len(same)] if len(same) else 0
    yield pairs[same[: len(pairs)]].astype(np.int32), kept[before]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw & 0xC0 != 0x80, out=lead[1:])
    chars = lead[offsets]  # code points before each text
    n = len(points) - 3
    if n <= 0:
        yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        return
    code = np.zeros(n, tk.U)
    for k in range(4):
        code = code * tk.BASES[0] + points[k : k + n]
    slot = (tk.mix(code) >> shift).astype(np.int32)
    inside = np.ones(len(points), bool)
    for k in (1, 2, 3):
        at = chars[1:] - k
        inside[at[at >= 0]] = False
    ok = np.zeros(n + 1, np.int64)
    np.cumsum(inside[:n], out=ok[1:])
    yield slot[inside[:n]], ok[np.minimum(chars, n)]


@dataclass
class Model:
    """weights: one table a block; a text's margin is bias plus the mean weight of each block. slope and
    shift: Platt's calibration of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, raw, offsets, words) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for table, (slots, before) in zip(self.weights, hashed(raw, offsets, words), strict=True):
            total = np.zeros(len(slots) + 1)
            np.cumsum(table[slots], out=total[1:], dtype=np.float64)
            out += (total[before[1:]] - total[before[:-1]]) / np.maximum(np.diff(before), 1)
        return out

    def likelihoods(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def shares(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its slots of all blocks (ascending, block x 2**BITS + slot) and their shares of the block."""
    starts, ends, before = tk.spans_of(raw, offsets)
    words = (tk.unit_hashes(raw, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(before)), before)
    blocks = list(hashed(raw, offsets, words))
    out = []
    for i in range(len(offsets) - 1):
        slots, values = [], []
        for b, (all_slots, at) in enumerate(blocks):
            slot, n = np.unique(all_slots[at[i] : at[i + 1]], return_counts=True)
            slots.append(slot + np.int32(b << BITS))
            values.append((n / max(n.sum(), 1)).astype(np.float32))
        out.append((np.concatenate(slots).astype(np.int32), np.concatenate(values)))
    return out


def _share_batches(batches):
    for batch, raw, offsets in tk.chunks(batches):
        rows = shares(raw, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "slots", "shares"])


def _use_batches(batches):
    """How many rows of each label use each slot, over the rows of a task."""
    uses = np.zeros((2, BLOCKS << BITS), np.int64)
    for batch in batches:
        for label, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uses[label, np.frombuffer(slots, np.int32)] += 1
    at = np.flatnonzero(uses.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(uses[0, at]), pa.array(uses[1, at])], ["slot", "n0", "n1"])


def chosen_slots(n0: np.ndarray, n1: np.ndarray, rows: tuple[int, int], most: int) -> np.ndarray:
    """Which slots have a weight: the `most` that tell the labels apart best (chi-square), earlier ones first of equals."""
    n, total = n0 + n1, max(sum(rows), 1)
    expected = n * (rows[1] / total)
    spread = np.maximum(n * (rows[0] / total) * (rows[1] / total) * (total - n + 1) / total, 1e-9)
    order = np.lexsort((np.arange(len(n)), -((n1 - expected) ** 2) / spread))
    return np.sort(order[:most])


def train(x: np.ndarray, used: np.ndarray, y: np.ndarray) -> Model:
    """AdaGrad on the logistic loss over four fifths of the rows, then Platt's scaling on the other fifth.
    x: the rows' shares of the slots `used`.
    Without rows of both classes the model gives the share of label 1 (one where there are no rows)."""
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    log_odds = float(np.log(share / (1 - share)))
    weights = np.zeros(BLOCKS << BITS, np.float32)
    if len(y) < 10 or y.min() == y.max():
        return Model(weights.reshape(BLOCKS, -1), 0.0, 0.0, log_odds)
    fit_rows = np.arange(len(y)) % 5 != 0
    w, bias, squares = np.zeros(len(used)), log_odds, np.full(len(used), 1e-12)
    n = fit_rows.sum()
    margins = lambda: x @ w.astype(np.float32) + bias
    for _ in range(STEPS):
        error = np.where(fit_rows, 1 / (1 + np.exp(-np.clip(margins(), -40, 40))) - y, 0) / n
        grad = error.astype(np.float32) @ x + L2 * w
        squares += grad**2
        w -= RATE * grad / np.sqrt(squares)
        bias -= RATE * error.sum()
    margin = margins()
    slope, shift = platt(margin[~fit_rows], y[~fit_rows])
    weights[used] = w
    return Model(weights.reshape(BLOCKS, -1), bias, slope, shift)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """slope and shift that make sigmoid(slope x margin + shift) a probability, by Newton steps on
    Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0 / max(margin.std(), 1e-9), 0.0])
    loss = lambda t: float(np.sum(np.logaddexp(0, a @ t) - target * (a @ t)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (p - target))
        size = 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Train on at most `most` labelled rows outside the held-out fold. Executors turn whole texts into slots;
    the driver gets one row a slot that LEAST_ROWS rows use, then the rows' shares of the `features` chosen slots,
    a matrix of `most` by `features`, so its memory depends neither on the length of texts nor on their number."""
    mark = tables_written()
    rows = written(training_rows(docs, labels, most).mapInArrow(_share_batches, "doc_id long, label int, slots binary, shares binary"), "shares")
    uses = rows.select("label", "slots").mapInArrow(_use_batches, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    uses = uses.where(F.col("n0") + F.col("n1") >= LEAST_ROWS).toPandas().sort_values("slot")
    marks = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    picked = chosen_slots(uses["n0"].to_numpy(), uses["n1"].to_numpy(), (marks.get(0, 0), marks.get(1, 0)), features)
    used = uses["slot"].to_numpy()[picked].astype(np.int32)
    del uses
    shared = docs.sparkSession.sparkContext.broadcast(used)  # `features` numbers

    def narrowed(batches):
        slots = shared.value
        for batch in batches:
            places, values = [], []
            for s, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                _, place, at = np.intersect1d(slots, np.frombuffer(s, np.int32), assume_unique=True, return_indices=True)
                places.append(place.astype(np.int32).tobytes())
                values.append(np.frombuffer(v, np.float32)[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "places", "shares"])

    kept = rows.mapInArrow(narrowed, "doc_id long, label int, places binary, shares binary").toPandas().sort_values(["doc_id", "label"])
    shared.destroy()
    release(docs.sparkSession, since=mark)  # everything that reads it has run
    x = np.zeros((len(kept), len(used)), np.float32)
    for row, places, values in zip(x, kept["places"], kept["shares"], strict=True):
        row[np.frombuffer(places, np.int32)] = np.frombuffer(values, np.float32)
    y = kept["label"].to_numpy(np.float64)
    del kept
    model = train(x, used, y)
    tk.give_back()
    return model


def judge(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, FIELDS, base_failed (under LEAST_WORDS words, or over half of
    them in three-word windows that repeat), kept (false where base_failed, else likelihood >= threshold),
    likelihood. Null text has no words and fails. Null and repeated doc_id return as they are; other
    columns are ignored; an empty table gives none."""
    model = model or fit(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BLOCKS x 2**BITS numbers
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch, raw, offsets in tk.chunks(batches):
            c, words = counts(raw, offsets)
            p = shared.value.likelihoods(shared.value.margins(raw, offsets, words))
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            columns = [pa.array(c[k], pa.int64()) for k in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *FIELDS, "base_failed", "kept", "likelihood"])

    return plain.mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in FIELDS)}, base_failed boolean, kept boolean, likelihood double")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text is kept, columns unchanged. The verdict travels with the row, so no
    join is needed and rows without or with a repeated doc_id have their own."""
    model = fit(docs, labels, options.get("most", TRAIN_ROWS))
    shared, threshold = docs.sparkSession.sparkContext.broadcast(model), options.get("threshold", THRESHOLD)

    def run(batches):
        for batch, raw, offsets in tk.chunks(batches):
            c, words = counts(raw, offsets)
            p = shared.value.likelihoods(shared.value.margins(raw, offsets, words))
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            yield batch.filter(pa.array(~failed & (p >= threshold)))

    return docs.mapInArrow(run, docs.schema)
