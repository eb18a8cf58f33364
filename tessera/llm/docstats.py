"""Counts of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_points", "n_shouts", "n_pipes", "n_spaces", "n_far", "longest")


def _class(octets: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(octets)] = True
    return out


_BYTES = {
    "n_chars": _class(bytes(b for b in range(256) if b & 0xC0 != 0x80)),
    "n_symbols": _class(SYMBOLS),
    "n_upper": _class(bytes(range(65, 91))),
    "n_digits": _class(bytes(range(48, 58))),
    "n_points": _class(b".,;:?"),
    "n_shouts": _class(b"!"),
    "n_pipes": _class(b"|"),
    "n_spaces": tk.SPACES,
    "n_far": _class(bytes(range(0xC0, 256))),
}


def counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """COUNTS of each text as int64 arrays, and the words: (feature hashes, text of each, how many
    before each text). Words and lines are compared by their bytes.

    word_chars: code points in words. n_dup_lines: lines with a word equal to an earlier line of the
    text. n_repeat_words: words in three-word windows found twice or more in the text.
    """
    n = len(offsets) - 1
    out = {"n_bytes": np.diff(offsets)} | {k: tk.counts_by_text(offsets, c[raw]) for k, c in _BYTES.items()}
    starts, ends, before = tk.spans_of(raw, offsets)
    out["n_words"] = np.diff(before)
    inside = ~tk.SPACES[raw] & _BYTES["n_chars"][raw]
    out["word_chars"] = tk.counts_by_text(offsets, inside)
    codes, distinct = tk.coded(raw, starts, ends)
    hashes, text = tk.slots_of(distinct)[codes], np.repeat(np.arange(n), np.diff(before))
    own = text * max(len(distinct), 1) + codes  # below bytes squared
    fresh = np.sort(own)
    fresh = fresh[np.append(True, fresh[1:] != fresh[:-1])] if len(fresh) else fresh
    out["n_distinct"] = np.bincount(fresh // max(len(distinct), 1), minlength=n)
    out["longest"] = np.zeros(n, np.int64)
    full = out["n_words"] > 0
    if full.any():
        out["longest"][full] = np.maximum.reduceat(ends - starts, before[:-1][full])
    out["n_repeat_words"] = np.zeros(n, np.int64)
    at = np.flatnonzero(text[:-2] == text[2:])
    if len(at):
        which = tk.groups_of(text[at], codes[at], codes[at + 1], codes[at + 2])
        twice = at[np.bincount(which)[which] > 1]
        covered = np.zeros(len(own), bool)
        for k in range(3):
            covered[twice + k] = True
        out["n_repeat_words"] = tk.counts_by_text(before, covered)
    starts, ends, before = tk.lines_of(raw, offsets)
    out["n_lines"] = np.diff(before)
    with_word = tk.holds_word(raw, starts, ends)
    line_text = np.repeat(np.arange(n), np.diff(before))[with_word]
    codes, distinct = tk.coded(raw, starts[with_word], ends[with_word])
    _, first = np.unique(line_text * max(len(distinct), 1) + codes, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)
    return out, (hashes, text, np.concatenate([[0], np.cumsum(out["n_words"])]))
