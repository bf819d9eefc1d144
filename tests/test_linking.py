"""Visuals and what they belong to, by hand."""

from __future__ import annotations

import random

from gradeloom.operators import linking as L

V = "doc int, visual long, page int, order int, y0 double, context string"
Q = "doc int, question long, index int, page int, first int, last int, stem string"
M = "doc int, material long, first int, last int, page_start int, page_end int, low int, high int"


def frames(spark, visuals, questions, materials=(), bottoms=()):
    return (
        spark.createDataFrame([(1, *v) for v in visuals], V),
        spark.createDataFrame([(1, *q) for q in questions], Q),
        spark.createDataFrame([(1, *m) for m in materials], M),
        spark.createDataFrame([(1, *b) for b in bottoms], "doc int, page int, bottom double"),
    )


def test_following_question(spark):
    visuals = [(1, 1, 10, 50.0, ""), (2, 1, 30, 50.0, ""), (3, 1, 60, 205.0, ""), (4, 1, 60, 204.0, ""), (5, 3, 90, 9.0, ""), (6, 1, 12, 0.0, "")]
    questions = [(1, 1, 1, 12, 13, ""), (2, 2, 1, 39, 41, ""), (3, 3, 2, 70, 75, ""), (4, 4, 2, 71, 72, ""), (5, 5, 4, 99, 99, "")]
    v, q, _, b = frames(spark, visuals, questions, bottoms=[(1, 100.0), (1, 200.0)])
    got = {r.visual: r.following for r in L.following_question(v, q, b).collect()}
    # 2: the next on its page is 9 on; 3: below the page's last source, 4 is not; 5: its page has no source; 6: not its own place
    assert got == {1: 1, 2: None, 3: 3, 4: None, 5: None, 6: None}


def test_assignment(spark):
    visuals = [(1, 5, 100, 0.0, "统计 甲乙 丙丁"), (2, 5, 500, 0.0, "甲乙 丙丁 戊己"), (3, 5, 900, 0.0, ""), (4, 8, 700, 0.0, "")]
    questions = [(1, 7, 9, 98, 101, "x"), (2, 9, 9, 820, 830, "上图 甲乙 丙丁 戊己"), (3, 3, 1, 2, 3, "图")]
    materials = [(10, 88, 90, 5, 6, 6, 8), (11, 600, 699, 1, 2, None, None)]
    got = {r.visual: (r.target, r.kind, r.score, r.confidence, r.warning) for r in L.assigned(*frames(spark, visuals, questions, materials, [(5, 1.0)])).collect()}
    assert got[1] == (10, "material", 95, 0.95, None)
    assert got[2] == (2, "question", 50, 0.5, "visual_assignment_low_confidence")  # far off, but it points back and shares three words
    assert got[3] == (None, None, None, None, "visual_unassigned")
    assert got[4] == (11, "material", 45, 0.45, "visual_assignment_low_confidence")  # by order alone


def test_material_that_is_for_the_question(spark):
    """The question has 82 (inside 40, hint 25, near 17), the material 75 (near 45, range 20, context 10)."""
    visuals, questions = [(1, 5, 100, 0.0, "统计")], [(1, 7, 9, 99, 101, "图 x")]
    for low, high, want in ((6, 8, ("material", 75)), (8, 9, ("question", 82)), (None, None, ("question", 82))):
        got = L.assigned(*frames(spark, visuals, questions, [(11, 80, 90, 4, 4, low, high)], [(5, 1.0)])).first()
        assert (got.kind, got.score) == want


def test_nothing(spark):
    v, q, m, b = frames(spark, [(1, 1, 1, 0.0, None)], [(1, 1, 1, 1, 1, None)], [(1, 1, 1, 1, 1, None, None)], [(1, 1.0)])
    assert L.assigned(v.limit(0), q, m, b).count() == 0
    got = L.assigned(v, q.limit(0), m.limit(0), b.limit(0)).first()
    assert got.warning == "visual_unassigned"
    assert L.assigned(v, q, m, b).count() == 1


def test_backward_links(spark):
    questions = [(1, 1, 10.0, 20.0, None), (1, 2, 30.0, 40.0, None), (1, 3, 90.0, 99.0, "a"), (1, 4, 95.0, 99.0, "b"), (2, 5, 0.0, 9.0, None), (2, 6, 5.0, 9.0, "c"), (3, 7, 0.0, 9.0, None), (1, 8, 41.0, 51.0, None)]
    materials = [(1, 1, "a", 50.0), (1, 2, "b", 60.0), (1, 3, "z", 80.0), (2, 1, "c", 50.0), (3, 1, "d", 50.0)]
    q = spark.createDataFrame(questions, "page int, index int, y0 double, y1 double, material string")
    m = spark.createDataFrame(materials, "page int, place int, material string, y0 double")
    got = sorted(tuple(r) for r in L.backward_links(q, m).collect())
    # 8 ends below a, so a takes 2, and b what is left above it: 8; z and d are no question's, c's question is above it
    assert got == [(1, 2, "a"), (1, 8, "b")]
    assert L.backward_links(q.limit(0), m).count() == 0


def made(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, ""] + [" ".join(rng.choice(["甲乙", "丙丁", "戊己", "上图", "w1"]) for _ in range(3)) for _ in range(6)])
    some = lambda n: n if rng.random() < 0.9 else None
    docs = [1, 2, None]
    visuals = [(rng.choice(docs), k, some(rng.randrange(6)), some(rng.randrange(60)), some(rng.random() * 300), text()) for k in range(90)]
    questions = [(rng.choice(docs), k, some(rng.randrange(60)), rng.randrange(6), f := rng.randrange(60), f + rng.randrange(4), text()) for k in range(60)]
    materials = [(rng.choice(docs), k, f := rng.randrange(60), f + 3, p := rng.randrange(6), p + rng.randrange(2), some(20), some(40)) for k in range(40)]
    bottoms = [(rng.choice(docs), p, some(rng.random() * 200)) for p in range(6)]
    return [spark.createDataFrame(r, s) for r, s in ((visuals, V), (questions, Q), (materials, M), (bottoms, "doc int, page int, bottom double"))]


def test_one_shuffle(spark):
    plan = L.assigned(*made(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_all_visuals_once(spark):
    v, *rest = made(spark)
    got = L.assigned(v, *rest).collect()
    assert sorted((str(r.doc), r.visual) for r in got) == sorted((str(r.doc), r.visual) for r in v.collect())
    assert all(r.warning == "visual_unassigned" for r in got if r.doc is None) and sum(r.target is not None for r in got) > 20


def test_pairs_in_slices(spark, monkeypatch):
    rows = L._flat(L.elements(*made(spark))).orderBy("doc").toArrow()
    whole = L._assigned(rows)
    monkeypatch.setattr(L, "MOST", 1)
    assert L._assigned(rows).equals(whole)
