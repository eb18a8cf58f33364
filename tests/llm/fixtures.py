"""Small document tables with awkward rows, and helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(seed=1, n=60):
    """Copies, shared passages, constant runs, periods, nulls, empties, odd spaces and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    passage = [rng.choice(vocab) for _ in range(70)]
    out = []
    for i in range(n):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        kind = i % 10
        if kind in (1, 2):
            at = rng.randint(0, len(body))
            lo = rng.randint(0, 20)
            body[at:at] = passage[lo : lo + rng.randint(10, 50)]
        elif kind == 3:
            body = ["xx"] * rng.randint(10, 60) + body
        elif kind == 4:
            body = ["ab", "cd"] * rng.randint(5, 30) + body
        elif kind == 5 and out:
            out.append(rng.choice(out))
            continue
        elif kind == 6:
            out.append(rng.choice([None, "", "  \t\n", "one", "\x0b"]))
            continue
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for w in body))
    out.append(" ".join(rng.choice(vocab) for _ in range(5000)) + " " + " ".join(passage))
    out.append("z" * 50_000)
    return out
