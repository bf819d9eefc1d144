from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import language as L
from gradeloom.llm.queries import op5_language

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "tra", "üb", "gen"], "cc": ["ción", "ado", "que", "ñor"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def greedy(reference: str, text: str) -> int:
    """Phrases of the longest matches, found by searching the reference."""
    count = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in reference:
            j += 1
        count += 1
        i = j
    return count


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 16)
    rng = random.Random(2)
    texts = {k: speak(rng, k, 60) for k in SYLLABLES}
    p = L.Parser(texts)
    shown = {k: "".join(chr(c + 64) for c in p.symbol(t)) for k, t in texts.items()}
    tried = [p.symbol(speak(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 30)) + "xyz 日") for _ in range(40)]
    got = p.phrases(tried)
    for k, s in enumerate(tried):
        text = "".join(chr(c + 64) for c in s)
        assert got[k].tolist() == [greedy(shown[n], text) for n in p.names]


def test_every_learned_letter_counts(monkeypatch):
    """Scripts of more letters than the dense table has columns are told apart, and phrases
    are the longest matches over all letters."""
    monkeypatch.setattr(L, "SEGMENT", 16)
    rng = random.Random(5)
    alphabets = {"big": [chr(0x4E00 + k) for k in range(900)], "kin": [chr(0x4E00 + k) for k in range(600, 1500)], "latin": list("abcdefghijklmnopqrstuvwxyz"), "rare": list("աբգդեզէըթժ")}
    words = {k: ["".join(rng.choice(a) for _ in range(4)) for _ in range(400)] for k, a in alphabets.items()}
    write = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    texts = {k: write(k, 100 if k == "rare" else 1500) for k in alphabets}
    p = L.Parser(texts)
    tried = [(k, write(k, 20)) for k in alphabets for _ in range(15)]
    assert [lang for lang, _ in tried] == p.predict([t for _, t in tried])[0]
    shown = {k: "".join(chr(c + 64) for c in p.symbol(t)) for k, t in texts.items()}
    got = p.phrases([p.symbol(t) for _, t in tried])
    for row, (_, t) in zip(got.tolist(), tried, strict=True):
        assert row == [greedy(shown[n], "".join(chr(c + 64) for c in p.symbol(t))) for n in p.names]


def test_letters_of_every_plane():
    p = L.Parser({"a": "ab cd", "b": "xy z"})
    names, _ = p.predict(["\U00030000\U00030001", "\U0001f600", "\u2028 12"])
    assert names[0] != "und" and names[1:] == ["und", "und"]


def test_one_language_and_ties():
    assert L.Parser({"a": "ab cd"}).predict(["zz", "ab"])[0] == ["a", "a"]
    names, scores = L.Parser({"b": "ab cd", "a": "ab cd"}).predict(["ab cd", "zz"])
    assert names == ["a", "a"] and scores == [0.5, 0.5]


def test_common_texts_are_learned_once(spark):
    """Copies of a labelled text are one, and no more than a passage of it is collected."""
    rows = [("same words again", "aa")] * 3000 + [(f"text {k}", "aa") for k in range(5)] + [("ab " * 50_000, "bb")]
    found = L.sample(spark.createDataFrame(rows, "text string, lang string").repartition(4), 4, 100)
    assert [lang for lang, _ in found] == ["aa"] * 4 + ["bb"] and max(len(t) for _, t in found) == 100
    assert len(set(found)) == 5


def test_forty_thousand_characters_are_learned():
    assert {k: len(v) for k, v in L.learnt([("aa", "ab " * 30_000), ("bb", "c" * 100)]).items()} == {"aa": 40_000, "bb": 100}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(k, speak(rng, lang, rng.randrange(8, 200)), lang, "s", 1) for k, lang in enumerate(sorted(SYLLABLES) * 40)]
    return rows + [(500, None, "aa", "s", 1), (501, "", None, "s", 1), (502, "12 34 !?", "bb", "s", 1), (503, "日本語", None, "s", 1), (None, speak(rng, "bb", 50), "bb", None, 1), (505, speak(rng, "cc", 30_000), None, "s", 1)]


def test_query(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_language(spark, str(tmp_path)).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for d, r in by.items():
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert [by[d]["lang_pred"] for d in (500, 501, 502)] == ["und"] * 3
    assert by[503]["lang_pred"] in SYLLABLES
    assert by[505]["lang_pred"] == "cc" and by[None]["lang_pred"] == "bb"
    held = [(by[d]["lang_pred"], lang) for d, _, lang, *_ in corpus[:120] if by[d]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_nothing_learned(spark, no_docs, docs):
    assert L.identify(no_docs, no_docs).count() == 0
    got = L.identify(docs, docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in got.collect()} == {("und", 0.0)}


def test_ids_and_labels_are_no_inputs(spark, corpus):
    """Held-out labels don't change a prediction."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    other = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("aa")).otherwise(F.col("lang")))
    run = lambda d: sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in L.identify(d, d.where(~L.held_out(F.col("doc_id")))).collect())
    assert run(df) == run(other)
