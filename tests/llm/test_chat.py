from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gradeloom.llm import chat as C
from gradeloom.llm.queries import CONFLICT, op9_chat
from gradeloom.llm.shared import shared_dir

ODD = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "|", "\n", "a", "é", "=", '"', "<\\|im_end|>", "[\\\\INST]", "im_end|>", "𝒳"]), max_size=8).map("".join)


@given(ODD, ODD)
def test_round_trip(role, text):
    segment, begin, end = C.format_turn(role, text)
    assert [t[:2] for t in C.parse(segment)] == [(role, text)]
    assert C.unescape(segment[begin:end]) == text
    assert not C._TOKEN.search(segment[begin:end])


@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_conversations_parse(turns):
    text = "".join(C.format_turn(*t)[0] for t in turns)
    assert [t[:2] for t in C.parse(text)] == turns


def test_only_conflicts_are_escaped():
    assert C.format_turn("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"
    assert "<\\/s>" in C.format_turn("user", "</s>")[0]


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>u\nx</s><|im_end|>\n", "<|im_start|>u\nx<|im_end|>", "<|im_start|>=x\ny<|im_end|>\n"])
def test_what_the_grammar_refuses(bad):
    with pytest.raises(C.NotChat):
        C.parse(bad)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "a</s>b"), (2, None, None, None), (2, 5, "assistant", None), (2, 7, "sys\ntem", "<|im_end|>\n"), (None, 0, "assistant", "é𝒳"), (3, 1, "assistant", "<|im_end|>" * 50_000), (3, 0, "user", "x" * 200_000)]


def test_query(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "file": F.lit("x")})
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op9_chat(spark, str(tmp_path)).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in [*ROWS, *CONFLICT]:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(C.format_turn(*t)[0]) for t in turns)


def test_turns_longer_than_a_read(spark):
    """A turn that goes over several reads, its end cut by one."""
    turns = spark.createDataFrame([(1, k, "assistant", "ab</s>é" * n) for k, n in enumerate((1, 300, 7, 5000))], "conv_id long, turn long, role string, text string")
    (r,) = C.write_chat(turns, shared_dir(spark)).collect()
    for step in (1, 7, 64, 1000):
        got = list(C.stream(r["file"], r["begin"], r["bytes"], step))
        assert [len(t[1]) for t in got] == [7 * n for n in (1, 300, 7, 5000)]


def test_no_conversations(spark):
    assert C.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
