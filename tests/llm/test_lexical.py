"""Lexical search against scores of all documents, by the contract's own words."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from gradeloom.llm.lexical import index, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    held = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for doc, w in held:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


ITEMS = [(1, "w1 w2 w2 W3"), (2, "word É日本 𝒳"), (3, None), (4, "..."), (5, "absent nowhere"), (6, "repeated row w7 " * 3), (6, "TWO words"), (7, "w1, w2; w3! w4? w5-w6")]


@pytest.mark.parametrize(("most", "postings", "at_once", "k"), [(4096, 500_000, 8_000_000, 10), (7, 40, 30, 3), (1, 1, 8_000_000, 100)])
def test_brute_force(spark, docs, rows, most, postings, at_once, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = search(index(docs, most, postings), items, k, at_once)
    assert found.schema["rank"].dataType.simpleString() == "int"
    got = sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == sorted(brute([(r[0], r[1]) for r in rows], ITEMS, k), key=str)


def test_copies_reach_the_bound(spark):
    """Thousands of equal documents tie at the k-th place: the least ids win."""
    copies = spark.range(3000).selectExpr("3000 - id AS doc_id", "'one two three' AS text")
    others = spark.range(3000).selectExpr("5000 + id AS doc_id", "'four' AS text")
    got = search(index(copies.union(others).repartition(4), 100), spark.createDataFrame([(1, "one two")], "item_id long, text string"), 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1


def test_empty(spark, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(index(no_docs), items).count() == 0
    some = index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert search(some, items.limit(0)).count() == 0
