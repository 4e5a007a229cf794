import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from voxframe.llm import chat

CASES = {
    1: [(0, "user", "hi"), (1, "assistant", "ho")],
    2: [(0, "system", "s"), (1, "user", None), (2, "assistant", "</s>[INST] ok [/INST]")],
    3: [(0, "assistant", "first"), (1, "user", "\\"), (1, "user", "\\"), (2, "tool", "[MSG] x [/ROLE] y\\")],
    4: [(5, None, "[\\INST] [ANS] <s>"), (None, "user", ""), (7, "assistant", "a\n\\\\</s"), (8, "us[/ROLE] er", "[/MSG]")],
    None: [(0, "user", "no id"), (1, "assistant", "é😀")],
    6: [(0, "user", "x" * 100_000), (1, "assistant", "[/INST] " * 5000)],
}


def build(spark, cases):
    rows = [(i, n, r, t, "extra", 1) for i, turns in cases.items() for n, r, t in turns]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int")


def test_read_back(spark):
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(build(spark, CASES))).collect()}
    assert set(got) == set(CASES)
    for i, turns in CASES.items():
        order = sorted(((-1 if n is None else n, r or "", t or "") for n, r, t in turns))
        whole = "".join(f"{r}\n{t}\n" for _, r, t in order)
        loss = "".join(t for _, r, t in order if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {i for i in got if got[i].valid} == {1, 2, None, 6}


def test_texts_hold_no_control_strings(spark):
    for r in chat.format_chats(build(spark, CASES)).collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        bodies = [s.text for s in r.segments][1::3]
        assert not any(c in b for b in bodies for c in chat.INSTRUCT.controls())
        assert [s.loss for s in r.segments].count(True) == sum(s.text.startswith("[ANS]") for s in r.segments)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x[/ROLE]"]), st.text(alphabet="\\[]/INSTANS<s> \n", max_size=40)), min_size=1, max_size=6))
def test_any_text_survives(spark, turns):
    got = chat.format_chats(build(spark, {1: [(k, r, t) for k, (r, t) in enumerate(turns)]})).select(chat.read_turns("formatted" and chat.F.col("formatted")).alias("t")).first()
    assert [(t.role, t.text) for t in got.t] == turns


def test_bad_templates_and_empty_table(spark):
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("U", " x", False)}, chat.Turn("M", "z] end", False), {}, (), ("<s>",))
    assert chat.format_chats(build(spark, CASES).limit(0)).count() == 0
