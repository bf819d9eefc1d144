from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gradeloom.llm import mixing as M
from gradeloom.llm.queries import op1_mixing


@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 80))
def test_apportion_deals_seat_by_seat(sources, seats):
    """As if each seat went to the highest quotient in turn."""
    weights, most = (np.array(x) for x in zip(*sources, strict=True))
    want = np.zeros(len(weights), int)
    for _ in range(min(seats, most.sum())):
        q = np.where(want < most, weights / (want + 0.5), -1)
        want[int(np.argmax(q))] += 1
    got = M.apportion(weights, seats, most)
    assert got.sum() == want.sum() and (got <= most).all()
    assert np.allclose(sorted((weights / (got + 0.5))[got < most]), sorted((weights / (want + 0.5))[want < most]))


def test_targets():
    t = M.targets(np.array([10, 1000, 1000]), np.array([5.0, 2, 1]), 3)
    assert t[0] == 30 and t.sum() == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    assert M.targets(np.zeros(2), np.ones(2), 3).tolist() == [0, 0]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 9), st.integers(0, 27))
def test_taken(sizes, blocks, quota):
    sizes, quota = np.array(sizes), min(quota, 3 * blocks)
    got, bounds, times = M.taken(sizes, quota, blocks, 1)
    flat = np.repeat(times, np.diff(bounds))
    ends = np.cumsum(sizes)
    assert got.tolist() == [int(flat[e - n : e].sum()) for e, n in zip(ends, sizes, strict=True)]
    assert (got <= 3 * sizes).all() and times.sum() == quota


def test_query(spark, folder, rows):
    got = op1_mixing(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in rows)
    size = {(d, s): len((t or "").encode().split()) for d, t, _, s, _ in rows}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"], r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    for k, s in enumerate(names):
        total = sum(r["size"] for r in by[s])
        assert {r["source_size"] for r in by[s]} == {total}
        (target,) = {r["target"] for r in by[s]}
        assert target <= 3 * total + 1e-9
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 40
    free = [k for k, s in enumerate(names) if by[s][0]["target"] < 3 * by[s][0]["source_size"] - 1e-6]
    share = {round(by[names[k]][0]["target"] / (5, 2, 1)[k % 3], 6) for k in free}
    assert len(share) == 1
    again = op1_mixing(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_texts_of_the_mix(spark, docs, rows, no_docs):
    """Each time a document is taken its words are its own, in order; as many as are taken."""
    out = M.mixed_texts(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in out.collect():
        taken[r["doc_id"]] += len(r["text"].encode().split())
    want = Counter()
    for r in M.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +want == +taken
    assert M.mixed_texts(no_docs).count() == 0
    assert M.mix(no_docs).count() == 0


@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 300))
def test_allocate_deals_the_highest_quotient(sources, words):
    """Every block's quotient that was dealt is at least any that wasn't but for what doesn't fit."""
    target, length, most = (np.array(x) for x in zip(*sources, strict=True))
    got = M.allocate(target, length, words, most)
    assert (got <= most).all() and (got * length).sum() <= words
    quotient = target / length / (got + 0.5)
    left = words - int((got * length).sum())
    for k in np.flatnonzero(got < most):
        # a block more of k: it doesn't fit, or a worse one was dealt in the last round of ties
        dealt = (target / length / (got - 0.5))[got > 0]
        assert length[k] > left or not len(dealt) or quotient[k] <= dealt.min() + 1e-9


@pytest.mark.parametrize("sizes", [[10] * 60, [3000] + [5] * 199, list(range(1, 51)) * 4])
def test_many_small_sources(spark, sizes):
    """Each source's words come within a block of its own of the target."""
    rows = [(k * 10 + j, f"s{k:04d}", " ".join(["w"] * (n // 2 if j else n - n // 2))) for k, n in enumerate(sizes) for j in range(2)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        size = sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= min(32, max(1, size // 64)) + 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_words_are_the_contracts(spark):
    """Only the six ASCII characters are gaps, wherever they stand."""
    import re

    from gradeloom.llm.shared import n_words

    texts = ["a \x85", "a ", " a  b \n", "\r\n", "x \r\n", "\x1c \x1f", "\xa0", "", "  a\x0bb\x0c ", "a\n\x85\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    from pyspark.sql import functions as F

    got = {r["k"]: r["n"] for r in df.select("k", n_words(F.col("text")).alias("n")).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in enumerate(texts)}
