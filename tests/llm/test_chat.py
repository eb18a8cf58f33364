import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.chat import PROBE, Template, digests, format_chats, read_back, segments_of

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "<", "|", "<|", "a<", "\\", "\n", "", None, "é😀", "<|im_end|>\n<|im_start|>user\nhi", "<<||", "\\n"]


def brute(rows):
    """Digests of turns and of assistant texts from the rows themselves."""
    out = {}
    key = lambda r: [(x is not None, x) for x in (r[1], r[2], r[3])]
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def conversations(seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.randint(1, 9)):
            text = rng.choice(TRICKY)
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "tool", "odd\nrole\\", "<|im_end|>"]), text if text is None else text + rng.choice(TRICKY[:5]) + str(t)))
    return rows + [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "assistant", "tie"), (3, 2, "user", "tie"), (n, 0, "assistant", "long <|" * 20_000)]


def test_digests_read_back(spark):
    rows = conversations()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", segment string, loss int").repartition(5)
    got = {r.conv_id: tuple(r)[1:5] for r in digests(docs).collect()}
    assert got == brute(rows + PROBE) and -1 in got


def test_segments_join_to_the_formatted_text(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "ok <|"), (2, 0, "user", "alone")]
    segments = format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "segment").collect()
    text = "".join(s.text for s in segments if s.conv_id == 1)
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\n<\\|im_end|><|im_end|>\n<|im_start|>assistant\nok <\\|<|im_end|>\n"
    assert [s.text for s in segments if s.loss] == ["ok <\\|"] and [s.segment for s in segments if s.conv_id == 1] == list(range(9))
    assert [s.fault for s in segments if s.conv_id == 2] == [None, None, None, "end"]
    got = {r.conv_id: (r.formatted_chars, r.valid, r.first_fault) for r in read_back(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: (len(text), True, None), 2: (len("<|im_start|>user\nalone<|im_end|>\n"), False, 1)}


def test_stored_segments_are_sorted_first(spark, tmp_path):
    rows = conversations(2)
    format_chats(spark.createDataFrame(rows, SCHEMA)).repartition(7, "text").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert {r.conv_id: tuple(r)[1:5] for r in read_back(stored, stored=True).collect()} == brute(rows)


def test_the_machine_finds_the_first_fault():
    faults = lambda *roles: [s[5] for s in segments_of(((1, r, "t") for r in roles), Template()) if s[5]]
    assert faults("system", "user", "assistant", "tool", "tool", "assistant") == []
    assert faults("assistant") == ["order"] and faults("user", "user", "assistant") == ["order"]
    assert faults("user", "judge", "assistant") == ["role"] and faults("user", "assistant", "user") == ["end"] and faults("system", None) == ["role", "end"]


def test_out_of_order_and_foreign_text_raise():
    whole = list(segments_of(iter([(1, "user", "a"), (1, "assistant", "b")]), Template()))
    with pytest.raises(ValueError, match="order"):
        list(chat._read(iter([whole[0], whole[2]]), Template()))
    with pytest.raises(ValueError, match="complete"):
        list(chat._read(iter(whole[:4]), Template()))
    with pytest.raises(ValueError, match="begins"):
        list(chat._read(iter([(1, 0, 0, "hello, this is text\n", False, None)]), Template()))


def test_empty_table_and_templates(spark):
    assert [r.conv_id for r in digests(spark.createDataFrame([], SCHEMA)).collect()] == [-1]
    other = Template(begin="<#turn ", after_role=" ", end="<#done", after_end="", opens="<#")
    rows = [(1, 0, "user", "<#done <#turn x"), (1, 1, "assistant", "<\\# y <|im_end|>")]
    got = read_back(format_chats(spark.createDataFrame(rows, SCHEMA), other), other).first()
    assert tuple(got)[1:5] == brute(rows)[1]
    for wrong in ({"opens": "<"}, {"opens": "<<", "begin": "<<a", "end": "<<b"}, {"end": "END"}, {"after_role": ""}, {"begin": "<|x|>", "end": "<|x|>"}):
        with pytest.raises(ValueError):
            Template(**wrong)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\n\nab"), st.text(alphabet="<|\\im_endstart>\n")), min_size=1, max_size=6))
def test_every_text_comes_back(turns):
    segments = list(segments_of(((1, r, t) for r, t in turns), Template()))
    reader = chat.Reader(1, Template())
    for _, *s in segments:
        reader.feed(*s)
    assert reader.row()[1:3] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
    assert all("<|" not in Template().escape(t) and Template().unescape(Template().escape(t)) == t for pair in turns for t in pair)
