"""Reviews applied to questions, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import vision_review as V

VISUALS = "array<struct<visual_id: string, belongs: boolean, linked_by: string, link_reason: string, role: string, summary: string, status: string, confidence: double, error: string>>"
KINDS = {
    "question_type": "string", "answer": "string", "answer_confidence": "double", "answer_unknown_reason": "string", "reasoning": "string", "analysis": "string",
    "analysis_unknown_reason": "string", "question_intent": "string", "can_answer": "boolean", "missing_context": "int", "audit_status": "string", "audit_verdict": "string",
    "audit_summary": "string", "risk_flags": "array<string>", "review_reasons": "array<string>", "quality_reasons": "array<string>", "needs_review": "boolean",
}
REVIEW = "layout int, page int, n int, question_id string, question_no string, visuals " + VISUALS + ", " + ", ".join(f"{k} {t}" for k, t in KINDS.items())
QUESTION = f"layout int, place long, id string, index int, images {V.STATE['images']}, flags array<string>, warnings array<string>, needs_review boolean, extra string"


def image(ref, **values):
    return {"ref": ref, "role": "stem"} | values


def visual(visual_id, belongs=True, **values):
    return {"visual_id": visual_id, "belongs": belongs} | values


def review(page, n, question_id=None, question_no=None, visuals=(), **values):
    return {"layout": 1, "page": page, "n": n, "question_id": question_id, "question_no": question_no, "visuals": list(visuals)} | dict.fromkeys(KINDS) | values


def run(spark, questions, reviews, visuals=()):
    q = spark.createDataFrame([(1, *x) for x in questions], QUESTION)
    r = spark.createDataFrame(reviews, REVIEW)
    v = spark.createDataFrame([(1, *x) for x in visuals], "layout int, ref string, role string")
    return {x.place: x for x in V.reviewed(q, r, v).collect()}


def question(place, index, images=(), flags=None, warnings=None):
    return (place, f"id{place}", index, list(images), flags, warnings, None, "e")


def test_id_then_number(spark):
    reviews = [review(1, 0, "id7", "9", audit_status="passed", can_answer=True), review(1, 1, "gone", "4"), review(1, 2, None, "99"), review(1, 3), review(1, 4, "q4", None)]
    got = run(spark, [question(7, 3), question(8, 4), question(9, 9)], reviews)
    assert [len(got[k].corrections) for k in (7, 8, 9)] == [1, 2, 0]
    assert got[7].audit_status == "passed" and not got[7].needs_review and got[7].warnings == [] and got[7].extra == "e"
    assert got[8].audit_status == "warning" and got[8].audit_verdict == "需复核" and got[8].needs_review and got[8].warnings == [V.NEEDS_REVIEW]
    assert got[9].audit_status is None and got[9].needs_review is False


def test_reviews_in_order(spark):
    reviews = [
        review(2, 0, "id1", answer="x", analysis="why", audit_status="Passed", can_answer=True, answer_confidence=0.2, question_type="t", risk_flags=["b", " ", "a"]),
        review(1, 5, "id1", answer=" c", answer_unknown_reason="blur", audit_status="failed", audit_summary="s1", answer_confidence=0.9, question_type="t", risk_flags=["a"], missing_context=2),
    ]
    one = run(spark, [question(1, 1, flags=["old"])], reviews)[1]
    assert one.candidate_answer == "C" and one.answer_unknown_reason == "blur" and one.candidate_analysis == "why"
    assert one.audit_status == "passed" and one.audit_verdict == "可通过" and one.audit_summary == "why"
    assert one.flags == ["old", "a", "missing_context", "blur", "b"] and one.points == ["t"]
    assert (one.answer_confidence, one.ai_confidence, one.can_solve, one.can_understand) == (0.2, 0.9, True, True)
    assert [(c.page, c.status, c.reason, c.confidence) for c in one.corrections] == [(1, "suggested", "s1", 0.9), (2, "applied", "why", 0.9)]
    assert one.needs_review and one.warnings == [V.NEEDS_REVIEW]


def test_images_by_key(spark):
    reviews = [
        review(1, 0, "id1", "1", [visual("a", summary="A", confidence=0.4), visual("new", summary="N", status="failed", error="e"), visual("unknown", summary="U"), visual("other", belongs=False)]),
        review(1, 1, "id1", "1", [visual("a", status="partial"), visual("new", summary="N2")]),
        review(1, 2, "id2", None, [visual(None, False, role="options", link_reason=" near ")]),
    ]
    got = run(spark, [question(1, 1, [image("a"), image("b")]), question(2, 2, [image("c", summary="C"), image("d")])], reviews, [("new", "material"), ("other", "stem"), ("a", "stem")])
    one = {i.ref: i for i in got[1].images}
    assert list(one) == ["a", "b", "new"]
    assert (one["a"].summary, one["a"].status, one["a"].confidence, one["a"].belongs, one["a"].linked_no, one["a"].linked_by) == ("A", "partial", 0.4, True, "1", "ai")
    assert (one["b"].summary, one["b"].belongs) == (None, None)  # not spoken of
    assert (one["new"].summary, one["new"].status, one["new"].error, one["new"].role) == ("N2", "failed", "e", "material")
    assert (got[1].visual_summary, got[1].visual_status, got[1].visual_confidence, got[1].visual_error, got[1].has_visual) == ("N2", "partial", 0.4, "e", True)
    two = {i.ref: (i.role, i.summary, i.status, i.belongs, i.link_reason, i.linked_no) for i in got[2].images}
    assert two == {"c": ("options", "C", "success", False, "near", "2"), "d": ("options", "", "partial", False, "near", "2")}
    assert got[2].visual_status == "partial" and got[2].visual_summary is None


@pytest.mark.parametrize(("statuses", "want"), [(["failed"], "failed"), (["Failed", "success"], "partial"), (["success", "partial"], "partial"), (["success", "skipped"], "success"), (["skipped"], "skipped"), (["?"], "partial")])
def test_status_of_several(spark, statuses, want):
    assert spark.range(1).select(V.aggregate_status(F.array(*[F.lit(s) for s in statuses])).alias("s")).first().s == want


def test_nothing(spark):
    assert run(spark, [question(1, None)], [review(1, 0, "", "")])[1].corrections == []
    assert run(spark, [], [review(1, 0, "id1")]) == {}


def test_without_id_or_visual(spark):
    reviews = [review(1, 0, " ", "3", [visual("", summary="S")]), review(1, 1, None, "gone"), review(1, 2, "id8", None, [visual(" new ", summary="N")]), review(2, 0, "none", " 3 ")]
    got = run(spark, [question(7, 3, [image("a")]), question(8, 4), question(9, 3)], reviews, [(None, "stem"), ("", "stem"), ("new", "stem"), ("new", "material")])
    assert [len(got[k].corrections) for k in (7, 8, 9)] == [2, 1, 0]  # the first place of a number counts
    assert [(i.ref, i.summary) for i in got[7].images] == [("a", "S")] and [(i.ref, i.role, i.summary) for i in got[8].images] == [("new", "material", "N")]


def test_bounded_tasks(spark):
    """Tasks that read questions count no names, and reviews are read once."""
    q, r = spark.createDataFrame([], QUESTION), spark.createDataFrame([], REVIEW)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(V.matched_reviews(q, r))
    v = spark.createDataFrame([], "layout int, ref string, role string")
    assert sum("audit_verdict" in x and "LogicalRDD" in x for x in plan(V.reviewed(q, r, v)).splitlines()) == 1
