"""Personal data: plain identifiers, and disguised ones found after offset-preserving normalisation."""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

KINDS = ("email", "ip", "card", "phone")
#: Digits by name, signs by name. Fixed values.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGNS = {"plus": "+", "más": "+", "mas": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-"}
DOTS = ("dot", "point", "punkt", "punto")
ATS = ("at", "arroba")
#: Last labels that make a bare "name at host dot com" an address. Fixed values.
BARE_ENDINGS = frozenset("com org net edu gov info biz io co dev app ai uk us ca de fr es it eu ch at nl be pt mx ar".split())
#: Letters and signs that look like ASCII ones and that compatibility forms don't cover. Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "г": "r",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "․": ".", "。": ".", "٫": ".", "·": ".",
}
#: Characters that show nothing: soft hyphen, zero-width ones, joiners, marks of direction. Fixed values.
UNSEEN = "­​‌‍⁠﻿‎‏"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OPEN, _SHUT = r"[\[\(\{<]\s{0,3}", r"\s{0,3}[\]\)\}>]"
_DOT_WORDS = "|".join(DOTS)
_HIDDEN_DOT = re.compile(rf"\s{{0,3}}{_OPEN}(?:{_DOT_WORDS}|\.){_SHUT}\s{{0,3}}|\s{{1,3}}(?:{_DOT_WORDS})\s{{1,3}}|_dot_|-dot-", re.I)
_BEFORE_DOT = re.compile(rf"(?:{_HIDDEN_DOT.pattern})$", re.I)
_HIDDEN_AT = re.compile(rf"\s{{0,3}}{_OPEN}(?:at|arroba|@|a){_SHUT}\s{{0,3}}|\s{{1,3}}(?:at|arroba)\s{{1,3}}|_at_|-at-|\s{{1,3}}@\s{{0,3}}|@\s{{1,3}}|@", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NUMBER = re.compile(rf"[0-9]+|\+|{_OPEN}(?:{_DOT_WORDS}|\.){_SHUT}|" + r"\b(?:" + "|".join(sorted([*DIGITS, *SIGNS], key=len, reverse=True)) + r")\b", re.I)
_GAP = re.compile(r"[\s,;:()\-/]{0,4}$")
#: A disguised dot with a figure on both sides.
_FIGURE_DOT = re.compile(rf"(?<=[0-9])(?:{_HIDDEN_DOT.pattern})(?=[0-9])", re.I)
_BOXED_DOT = re.compile(rf"{_OPEN}(?:{_DOT_WORDS}|\.){_SHUT}", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, leftmost and non-overlapping within a kind, in order of kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


class Traced:
    """A normalised text that knows the source range of each of its characters: pieces copied from a parent
    text or put for a range of it, so the cost is that of the edits."""

    def __init__(self, text: str, parent: Traced | None = None, begins: list[int] = (), pieces: list[tuple[int, int, bool]] = ()):
        self.text, self.parent, self.begins, self.pieces = text, parent, begins, pieces

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.parent is None:
            return a, b
        k, n = bisect.bisect_right(self.begins, a) - 1, bisect.bisect_right(self.begins, b - 1) - 1
        first, _, copied = self.pieces[k]
        begin, end, last_copied = self.pieces[n]
        return self.parent.source(first + (a - self.begins[k] if copied else 0), begin + b - self.begins[n] if last_copied else end)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace ranges (ascending, apart) by new characters; each of those has the whole range as source."""
        if not edits:
            return self
        out, begins, pieces, at, size = [], [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            for x, y, part, copied in ((at, a, self.text[at:a], True), (a, b, new, False)):
                if part:
                    out.append(part)
                    begins.append(size)
                    pieces.append((x, y, copied))
                    size += len(part)
            at = b
        return Traced("".join(out), self, begins, pieces)


def _look(c: str) -> str | None:
    """The ASCII character that c passes for, "" for an unseen one, None if neither."""
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c < "\x80":
        return None
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat < "\x80" else None


_LOOKS: dict[str, str] = {}
_FAR = re.compile("[^\x00-\x7f]+")


def _looks() -> dict[str, str]:
    if not _LOOKS:
        _LOOKS.update((c, x) for c in map(chr, range(128, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (x := _look(c)) is not None)
    return _LOOKS


def seen_as(text: Traced) -> Traced:
    """Transducer 1: homoglyphs and compatibility forms to ASCII, unseen characters away."""
    if text.text.isascii():
        return text
    looks = _looks()
    return text.rewritten([(k, k + 1, looks[c]) for m in _FAR.finditer(text.text) for k, c in enumerate(m.group(), m.start()) if c in looks])


def spelled_out(text: Traced) -> Traced:
    """Transducer 2: runs of at least four digits or signs (bracketed dots too), two spelled digits or
    one and three dots among them, to figures."""
    runs: list[list[re.Match]] = []
    for m in _NUMBER.finditer(text.text):
        gap = text.text[runs[-1][-1].end() : m.start()] if runs else "x"
        if len(gap) <= 4 and _GAP.match(gap):
            runs[-1].append(m)
        else:
            runs.append([m])
    edits = []
    for run in runs:
        words = ["dot" if _BOXED_DOT.fullmatch(m.group()) else m.group().lower() for m in run]
        n = len(words)
        while n and words[n - 1] in SIGNS:
            n -= 1
        run, words = run[:n], words[:n]
        spelled = sum(w in DIGITS for w in words)
        if len(words) >= 4 and (spelled >= 2 or (spelled and sum(w in DOTS for w in words) >= 3)):
            edits.append((run[0].start(), run[-1].end(), "".join(DIGITS.get(w) or SIGNS.get(w) or w for w in words)))
            # one range of source characters: a figure can't be cut out of the run
    return text.rewritten(edits)


def dotted(text: Traced) -> Traced:
    """Transducer 3: disguised dots between figures to dots."""
    return text.rewritten([(m.start(), m.end(), ".") for m in _FIGURE_DOT.finditer(text.text)])


class _Domains:
    """Labels joined by plain or disguised dots. Ends are remembered, so that many beginnings cost one walk."""

    def __init__(self, text: str):
        self.text, self.run, self.known = text, (0, 0), {}

    def label_end(self, at: int) -> int:
        """Where the label that `at` lies in ends; at itself if none."""
        if not self.run[0] <= at < self.run[1]:
            m = _LABEL.match(self.text, at)
            if not m:
                return at
            self.run = m.span()
        return self.run[1]

    def rest(self, end: int) -> tuple[int, int, bool, int]:
        """What follows a label that ends at `end`: (end of all, beginning of the last label or -1, a dot is
        disguised, dots)."""
        path, text = [], self.text
        while end not in self.known:
            dot = _HIDDEN_DOT.match(text, end)
            at = dot.end() if dot else end + 1 if text[end : end + 1] == "." else None
            stop = self.label_end(at) if at is not None else None
            if stop is None or stop == at:
                self.known[end] = (end, -1, False, 0)
                break
            path.append((end, at, bool(dot)))
            end = stop
        for start, at, disguised in reversed(path):
            stop, last, hidden, dots = self.known[end]
            self.known[start] = (stop, at if last < 0 else last, hidden or disguised, dots + 1)
            end = start
        return self.known[end]


def hidden_emails(text: Traced) -> list[tuple[int, int]]:
    """Transducer 4: at and dot disguises. Source ranges of addresses with at least one disguise."""
    found, done, plain = [], 0, text.text
    domains = _Domains(plain)
    for m in _HIDDEN_AT.finditer(plain):
        if m.start() < done:
            continue
        bare = m.group().strip().lower() in ATS
        label = domains.label_end(m.end())
        if label == m.end() or (bare and not plain[m.start() - 1 : m.start()].isalnum()):
            continue
        end, last, hidden, dots = domains.rest(label)
        if not dots:
            continue
        last = plain[last:end]
        sure = last.lower() in BARE_ENDINGS if bare or m.group() != "@" else last.isalpha() and len(last) >= 2
        if not sure or (bare and not hidden):
            continue
        start = m.start()
        while True:
            a = start
            while a > done and plain[a - 1] in _LOCAL:
                a -= 1
            if a == start:
                break
            start = a
            dot = _BEFORE_DOT.search(plain[max(done, start - 24) : start])
            if not dot:
                break
            before = start - len(dot.group())
            if before <= done or plain[before - 1] not in _LOCAL:
                break
            start, hidden = before, True
        if start == m.start() or (m.group() == "@" and not hidden):
            continue
        if plain[start] in _LOCAL:
            found.append(text.source(start, end))
            done = end
    return found


def _inside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """One of the spans (apart, ascending) holds [a, b)."""
    k = bisect.bisect_right(spans, a, key=lambda s: s[0]) - 1
    return k >= 0 and b <= spans[k][1]


def all_spans(text: str, disguised: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by start and then kind. A disguised find is added unless it equals or
    lies in a base span of its kind; one that reaches beyond a base span stands beside it."""
    base = plain_spans(text)
    found = set(base)
    if disguised:
        seen = seen_as(Traced(text))
        figures, points = spelled_out(seen), dotted(seen)
        more = [(k, *t.source(a, b)) for t in (seen, figures, points) for k, a, b in plain_spans(t.text)]
        more += [("email", *r) for r in hidden_emails(seen)]
        spans = {k: [(a, b) for x, a, b in base if x == k] for k in KINDS}  # apart, ascending
        found |= {(k, a, b) for k, a, b in more if not _inside(spans[k], a, b)}
    order = lambda s: sorted(s, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return order(base), order(found)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CLASS = np.zeros(256, np.uint8)  # of bytes that show what a text may hold: 1 digits or @, 2 beginnings of look-alikes
_CLASS[48:58] = 1
_CLASS[64] = 1
_CLASS[0xC2] = 2
_CLASS[0xC4:] = 2
_BREAKS = np.ones(256, bool)  # bytes between words of letters and digits
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = False
_BREAKS[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _bytes_in(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_OPENS, _SHUTS, _BEGINS = _bytes_in(b"[({<"), _bytes_in(b"])}>"), _bytes_in(b".@aA")
_BLANKS = _bytes_in(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")  # \s of one byte; the others are odd


def _cases(names) -> list[str]:
    """The names in the forms that differ once ASCII letters are folded."""
    return [*names, *(up for n in names if (up := "".join(c if c < "\x80" else c.upper() for c in n)) != n)]


def _hashes(names) -> np.ndarray:
    return np.sort(tk.slots_of([n.encode() for n in names]))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def hints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that can hold plain identifiers, and texts that can hold disguised ones; the tests never
    miss, they only spare the others: each alternative of the transducers' patterns has its mark here."""
    kind = _CLASS[raw]
    plain = tk.counts_by_text(offsets, kind == 1) > 0
    odd = tk.counts_by_text(offsets, kind == 2) > 0
    starts, ends, before = tk.spans_of(raw, offsets, _BREAKS)
    words = tk.unit_hashes(raw, starts, ends, _FOLD)
    short = ends - starts <= 8
    digit, dots = np.zeros(len(words), bool), np.zeros(len(words), bool)
    digit[short] = _among(words[short], _hashes(_cases(DIGITS)))
    dots[short] = _among(words[short], _hashes([*DOTS, *ATS[1:]]))
    found = np.zeros(len(raw), bool)
    if len(raw):
        after = np.append(raw[1:], 32)
        found = (raw == 64) & (_BLANKS[after] | _SHUTS[after])
        found[1:] |= (raw[1:] == 64) & (_BLANKS | _OPENS)[raw[:-1]]
        # a bracket, up to three blanks and what begins at, arroba, @ or a dot
        opened = _OPENS[raw]
        for _ in range(4):
            opened = np.append(False, opened[:-1])
            found |= opened & _BEGINS[raw]
            opened &= _BLANKS[raw]
        # _at_, -at-
        joined = (raw == 45) | (raw == 95)
        found[3:] |= joined[:-3] & ((raw[1:-2] | 32) == 97) & ((raw[2:-1] | 32) == 116) & joined[3:]
        # signs of multiplication and division end a word, but their bytes don't break it
        found[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    hidden = odd | (tk.counts_by_text(before, digit) > 1) | (tk.counts_by_text(before, dots) > 0) | (tk.counts_by_text(offsets, found) > 0)
    return plain, hidden


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (base and disguised ones, as kind:start:end in code points of the whole text, end exclusive,
    comma-joined by start and then kind), n_disguised.

    Null text counts as empty and has no spans. Null and repeated doc_id return as they are; other
    columns are ignored; an empty table gives none.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

    def run(batches):
        for batch, raw, offsets in tk.chunks(batches):
            possible, disguised = hints(raw, offsets)
            rows, data = [], raw.tobytes()
            for i, (p, d) in enumerate(zip(possible.tolist(), disguised.tolist(), strict=True)):
                if not (p or d):
                    rows.append(nothing)
                    continue
                base, spans = all_spans(data[offsets[i] : offsets[i + 1]].decode(), d)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
