from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from gradeloom.llm.queries import queries
from tests.llm.conftest import DOCS
from tests.llm.test_jaccard import brute
from tests.llm.test_language import SYLLABLES, speak


def test_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder).cache()
        steps.append(docs)
    language, near, mixed, packed = steps
    for df in steps[:3]:
        assert df.columns == list(C.COLUMNS)
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(r["doc_id"] for r in language.collect()) == Counter(d for d, *_ in letters)
    assert language.where("lang is null").count() == 0
    kept = {d for d, n, c in brute([tuple(r) for r in language.collect()], 5, 80, 100)[0] if d == c} | {None}
    assert Counter(r["doc_id"] for r in near.collect()) == Counter(dict.fromkeys(kept, 1))
    by = {r["doc_id"]: r["text"].split() for r in near.collect()}
    for r in mixed.collect():
        assert set(r["text"].split()) <= set(by[r["doc_id"]])
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_the_predicted_language_counts(spark):
    """A wrong lang is replaced, in documents that were not learned from."""
    rng = random.Random(6)
    rows = [(k, speak(rng, lang, 60), lang, "s", 1) for k, lang in enumerate(sorted(SYLLABLES) * 20)]
    held = {r["doc_id"] for r in spark.createDataFrame(rows, DOCS).where(C.held_out(F.col("doc_id"))).collect()}
    assert held
    wrong = [(d, t, "aa" if d in held else lang, s, n) for d, t, lang, s, n in rows]
    got = {r["doc_id"]: r["lang"] for r in C.language(spark, spark.createDataFrame(wrong, DOCS), "").collect()}
    assert got == {d: lang for d, _, lang, *_ in rows}


def test_nothing_learned_drops_only_letterless_texts(spark):
    rows = [(1, "words here", None, "s", 1), (2, "12 !?", None, "s", 1), (3, None, None, "s", 1), (4, "日本", None, "s", 1)]
    got = C.language(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(1, "und"), (4, "und")]


def test_registered(spark, folder):
    assert [s[0] for s in C.STAGES] == ["language id", "near duplicates", "mixing", "packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is C.run
    assert C.run(spark, folder).count() > 0
