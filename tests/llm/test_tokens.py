from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import packing as P
from gradeloom.llm import token_files as T
from gradeloom.llm.bpe import encoder
from gradeloom.llm.queries import op2_packing, op8_token_files, tokenizer

tokenizers = pytest.importorskip("tokenizers")
FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@functools.cache
def plain(name):
    inner = tokenizers.Tokenizer.from_file(tokenizer(name))
    return lambda t: inner.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "space"), FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("ab É's.,\n\t \0\x1c\x85 Ⅷ中́ſ7"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_chunks_encode_as_whole_texts(name, space, texts):
    got = encoder(tokenizer(name), space).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(name)(t) for t in texts]


@given(n=st.integers(0, 10_000), capacity=st.sampled_from([1, 7, 64, 1024]))
def test_cuts(n, capacity):
    lengths = P.classes(capacity)
    got = P.cuts(n, lengths)
    assert sum(got) == n and set(got) <= set(lengths)


def check_packed(got, rows, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append([*plain("byte_bpe_50k.json")(text), 0])
    for doc_id, texts in want.items():
        total = sum(len(t) for t in texts)
        assert sum(r["length"] for r in pieces[doc_id]) == total
        for r in pieces[doc_id]:
            crcs = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for t in texts if len(t) == r["doc_tokens"]}
            assert r["ids_crc32"] in crcs
    tokens = sum(r["length"] for r in got)
    padding = sum(capacity - n for s in sequences.values() if (n := sum(r["length"] for r in s)) & (n - 1))
    assert padding <= max(capacity, 0.02 * tokens)


def test_packing(spark, folder, rows):
    check_packed(op2_packing(spark, folder).collect(), rows, 1024)


def test_packing_in_levels(spark, docs, rows, monkeypatch):
    """Open bins that go to several tasks first, and to one last."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "PER_TASK", 20)
    out = P.pack(docs.repartition(9), tokenizer("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))
    check_packed(out.drop("ids").collect(), rows, 1024)


def test_no_documents(spark, no_docs, tmp_path):
    assert P.pack(no_docs, tokenizer("byte_bpe_50k.json")).count() == 0
    assert T.token_table(no_docs, tokenizer("word_bpe_49k.json")).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_ranks_round_trip(values):
    control, data = T.pack_ranks(np.array(values, "<u4"))
    assert T.unpack_ranks(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 20_000)
    monkeypatch.setattr(T, "BLOCK", 500)
    got = sorted(op8_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    by_id, at = defaultdict(list), 0
    for doc_id, text, *_ in rows:
        by_id[doc_id].append(np.array([*plain("word_bpe_49k.json")(text), 1], "<u4").tobytes())
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in {zlib.crc32(x) for x in by_id[r["doc_id"]] if len(x) == 4 * r["n_tokens"]}


def test_frequent_ids_take_one_byte(spark, docs, tmp_path):
    """The files are far smaller than plain ids."""
    shards = T.write_tokens(docs, f"file://{tmp_path}", tokenizer("word_bpe_49k.json"), False, 1).collect()
    size = sum((tmp_path / s["file"].rsplit("/", 1)[1]).stat().st_size for s in shards)
    assert size < 2.2 * sum(s["tokens"] for s in shards) + 17 * sum(s["documents"] for s in shards) + 48 * 40
    assert not list(tmp_path.glob("draft-*"))
