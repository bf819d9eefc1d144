from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import fingerprints as P
from gradeloom.llm.queries import op10_fingerprints


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def shingles(text):
    w = text.lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query(spark, folder, rows):
    got = op10_fingerprints(spark, folder).collect()
    assert len(got) == len(rows)
    texts = [t or "" for _, t, *_ in ordered(rows)]
    ids = [d for d, *_ in ordered(rows)]
    want, near = set(), {}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.add((ids[k], len(t), hashlib.sha256(edited.encode()).hexdigest()))
        near[ids[k]] = (t, edited, after)
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got} == want
    errors = []
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] == 8:  # two rows, each with a next of its own
            continue
        t, e, after = near[r["doc_id"]]
        for name, other in (("near_edited", e), ("near_next", after)):
            a, b = shingles(t), shingles(other)
            errors.append(abs(r[name] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.3
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] and by[0]["near_next"] == 1
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == ""


def test_one_and_none(spark, no_docs):
    assert P.edited_pairs(no_docs).count() == 0
    (r,) = P.edited_pairs(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"a b c da b c ").hexdigest()[:64] or r["n_chars"] == 13


def test_parts_merge(spark):
    """The merged sketch of parts is the sketch of all their shingles."""
    n = 3000
    df = spark.range(1).select(*[P.least(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.shiftrightunsigned(F.xxhash64(i), 16))).alias(c) for c, a, b in (("x", 1, 2000), ("y", 1001, n), ("z", 1, n))])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = df.select((P.merge(x, y) == z).alias("same"), P.resemblance(x, y).alias("r"), P.containment(x, y).alias("c"), P.distinct_shingles(z).alias("n"), (P.unpacked(P.packed(z)) == z).alias("back"), P.printed(z).alias("p")).first()
    assert r["same"] and r["back"] and "\n" not in r["p"]
    assert abs(r["r"] - 1 / 3) < 0.2 and abs(r["c"] - 0.5) < 0.25 and abs(r["n"] / n - 1) < 0.4


def test_no_python_in_the_plan(spark, folder):
    plan = op10_fingerprints(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_many_equal_doc_ids(spark):
    """Rows of one doc_id don't meet each other: each has the next text, and one row in all."""
    rows = [(None, f"{k} begins this text of many {'x' * (k % 7)}") for k in range(5000)] + [(7, "same")] * 5000
    got = P.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert len({r["edited_sha256"] for r in got if r["doc_id"] is None}) == 5000
    assert {r["near_next"] for r in got if r["doc_id"] == 7} == {0.0, 1.0}
    assert sum(r["near_next"] == 0 for r in got if r["doc_id"] == 7) == 1
