"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .docstats import counts
from .labelled import held_out, training_rows

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAF = 80, 4, 64, 0.15, 1.0, 10
N_FEATURES = 18


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics of each text: sizes on a log scale and shares; empty texts give finite values."""
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = [
        np.log1p(c["n_words"]), np.log1p(c["n_chars"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_upper"] / chars, c["n_digits"] / chars, c["n_points"] / words, c["n_shouts"] / words,
        c["n_pipes"] / words, c["n_spaces"] / chars, c["n_far"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_words"] / lines, np.log1p(c["longest"]), c["n_symbols"] / words,
        c["n_lines"] / words,
    ]
    return np.stack([np.asarray(x, np.float64) for x in columns], 1)


@dataclass
class Forest:
    """Complete trees of one depth as flat arrays: inner nodes have a feature and a threshold, leaves a
    value. Node i has the children 2i + 1 (value at most the threshold) and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosting on the logistic loss; splits come from histograms over quantile bins. Without rows of
    both classes the forest is the constant share of label 1 (one half without rows)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best, chosen, cut = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = at * BINS + binned[:, j]
                sums = [np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better], chosen[better], cut[better] = gain[np.arange(width), k][better], j, k[better]
            for w in np.flatnonzero(chosen >= 0):
                feature[first + w], threshold[first + w] = chosen[w], edges[chosen[w]][cut[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + L2)
        margin += value[leaf]
        out.append((feature, threshold, value))
    return Forest(base, *(np.stack(c) for c in zip(*out, strict=True)))


def _feature_batches(batches):
    for batch, raw, offsets in tk.chunks(batches):
        x = features(counts(raw, offsets)[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Forest:
    """Train on at most `most` labelled rows outside the held-out fold; that many rows of N_FEATURES
    numbers reach the driver, at any input size."""
    rows = training_rows(docs, labels, most).mapInArrow(_feature_batches, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    return train(np.array(rows["x"].tolist(), np.float64).reshape(-1, N_FEATURES), rows["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (likelihood of label 1), predicted (score >=
    threshold). Only texts are inputs of a score. Null text is scored as empty; held_out is false where
    doc_id is null; repeated rows return as often; other columns are ignored."""
    forest = fit(docs, labels, most)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch, raw, offsets in tk.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(features(counts(raw, offsets)[0])))], ["doc_id", "score"])

    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
