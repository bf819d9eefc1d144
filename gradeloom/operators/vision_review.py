"""Reviews of a vision model merged into the questions that they are of.

A review names its question by id, or, where that leads nowhere, by number.  A question's
reviews, of which there are few, are applied in order of page and place, each to what the one
before it left, in one fold; images are changed or added inside their array by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import arrays as A

IMAGE = "struct<ref: string, role: string, summary: string, status: string, confidence: double, error: string, belongs: boolean, linked_no: string, linked_by: string, link_reason: string>"
CORRECTION = "struct<page: int, confidence: double, status: string, reason: string>"
#: What a question has of its reviews; images, flags, warnings and needs_review it may bring along.
STATE = {
    "images": f"array<{IMAGE}>", "flags": "array<string>", "warnings": "array<string>", "needs_review": "boolean", "points": "array<string>",
    "candidate_answer": "string", "answer_confidence": "double", "answer_unknown_reason": "string", "candidate_analysis": "string", "analysis_unknown_reason": "string",
    "reasoning": "string", "visual_summary": "string", "visual_confidence": "double", "visual_error": "string", "visual_status": "string", "has_visual": "boolean",
    "audit_status": "string", "audit_verdict": "string", "audit_summary": "string", "can_understand": "boolean", "can_solve": "boolean", "ai_confidence": "double",
    "corrections": f"array<{CORRECTION}>",
}
#: What an audit's status says.
VERDICTS = {"passed": "可通过", "warning": "需复核", "failed": "不建议入库", "skipped": "需复核"}
ANSWERS = ("A", "B", "C", "D", "对", "错")
NEEDS_REVIEW = "ai_preaudit_needs_review"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _first(*columns: Column) -> Column:
    """The first text that isn't blank, or an empty one."""
    return F.coalesce(*[F.nullif(_text(c), F.lit("")) for c in columns], F.lit(""))


def _or(new: Column, old: Column) -> Column:
    """A new text, if it isn't blank."""
    return F.coalesce(F.nullif(_text(new), F.lit("")), old)


def _lines(values: Column) -> Column:
    return F.array_join(A.distinct_texts(values), "\n")


def aggregate_status(statuses: Column) -> Column:
    """What the statuses of several visuals are together."""
    own = F.transform(statuses, lambda s: F.lower(F.trim(s)))
    has = lambda s: F.array_contains(own, s)
    return F.when(has("failed"), F.when(F.forall(own, lambda s: s == "failed"), F.lit("failed")).otherwise(F.lit("partial"))).when(has("partial"), F.lit("partial")).when(
        has("success"), F.lit("success")
    ).when(has("skipped"), F.lit("skipped")).otherwise(F.lit("partial"))


def _with_visual(images: Column, v: Column, number: Column) -> Column:
    """A visual's review in the images: those of its key are changed, or all if one has none; one
    that belongs to the question and is not there is added, if the page has it."""
    key = _text(v["visual_id"])
    known = F.exists(images, lambda i: i["ref"] == key)
    added = F.when((key != "") & v["belongs"] & v["known_ref"].isNotNull() & ~known, F.array(image(key, v["known_role"]))).otherwise(F.array().cast(f"array<{IMAGE}>"))

    def changed(i: Column) -> Column:
        summary = _first(v["summary"], i["summary"])
        status = _first(v["status"], i["status"], F.when(summary != "", F.lit("success")).otherwise(F.lit("partial")))
        new = F.struct(
            i["ref"].alias("ref"), F.coalesce(v["role"], i["role"], F.lit("unknown")).alias("role"), summary.alias("summary"), status.alias("status"),
            F.coalesce(v["confidence"], i["confidence"]).alias("confidence"), F.coalesce(F.nullif(v["error"], F.lit("")), i["error"]).alias("error"),
            F.coalesce(v["belongs"], F.lit(False)).alias("belongs"), number.alias("linked_no"), _first(v["linked_by"], F.lit("ai")).alias("linked_by"), _text(v["link_reason"]).alias("link_reason"),
        )
        other = (key != "") & (_text(i["ref"]) != "") & (_text(i["ref"]) != key)
        return F.when(other, i).otherwise(new.cast(IMAGE))

    return F.transform(F.concat(images, F.coalesce(added, F.array().cast(f"array<{IMAGE}>"))), changed)


def image(ref: Column, role: Column) -> Column:
    """An image of which nothing has been said yet."""
    none = F.lit(None)
    return F.struct(ref.alias("ref"), role.alias("role"), *[none.cast(t).alias(n) for n, t in (("summary", "string"), ("status", "string"), ("confidence", "double"), ("error", "string"), ("belongs", "boolean"), ("linked_no", "string"), ("linked_by", "string"), ("link_reason", "string"))]).cast(IMAGE)


def _applied(q: Column, r: Column, index: Column) -> Column:
    """A question's state after a review."""
    number = F.coalesce(r["question_no"], index.cast("string"))
    visuals = r["visuals"]
    images = F.aggregate(visuals, q["images"], lambda a, v: _with_visual(a, v, number))
    of = lambda f: F.filter(F.transform(visuals, f), lambda x: x != "")
    summaries, errors = of(lambda v: _text(v["summary"])), of(lambda v: _text(v["error"]))
    statuses = of(lambda v: _first(v["status"], F.when(_text(v["summary"]) != "", F.lit("success"))))
    confidences = F.filter(F.transform(visuals, lambda v: v["confidence"]), lambda c: c.isNotNull())
    answer = F.upper(_text(r["answer"]))
    answer = F.when(answer.isin(*ANSWERS), answer).otherwise(F.lit(""))
    no_answer, no_analysis, analysis = _text(r["answer_unknown_reason"]), _text(r["analysis_unknown_reason"]), _text(r["analysis"])
    status = F.lower(_text(r["audit_status"]))
    status = F.when(status.isin(*VERDICTS), status).otherwise(F.lit("warning"))
    verdict = _first(r["audit_verdict"], F.element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), status))
    summary = _first(r["audit_summary"], r["reasoning"], analysis, verdict)
    can_answer = F.coalesce(r["can_answer"], F.lit(False))
    can_solve = can_answer & ((answer != "") | (no_answer == ""))
    empty = F.array().cast("array<string>")
    more = F.array(F.when(F.coalesce(r["missing_context"], F.lit(0)) > 0, F.lit("missing_context")), no_answer, no_analysis)
    flags = A.distinct_texts(F.concat(q["flags"], *[F.coalesce(r[c], empty) for c in ("risk_flags", "review_reasons", "quality_reasons")], F.array_compact(more)))
    answer_confidence = F.coalesce(r["answer_confidence"], q["answer_confidence"])
    visual_confidence = F.when(F.size(confidences) > 0, F.array_max(confidences)).otherwise(q["visual_confidence"])
    confidence = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in (q["ai_confidence"], answer_confidence, visual_confidence)])
    doubt = F.coalesce(r["needs_review"], F.lit(False)) | (F.size(flags) > 0) | (status != "passed") | ~can_solve
    review = F.coalesce(q["needs_review"], F.lit(False)) | doubt
    correction = F.struct(r["page"].alias("page"), confidence.alias("confidence"), F.when(status == "passed", F.lit("applied")).otherwise(F.lit("suggested")).alias("status"), summary.alias("reason"))
    values = {
        "images": images, "flags": flags, "warnings": F.when(review & ~F.array_contains(q["warnings"], NEEDS_REVIEW), F.concat(q["warnings"], F.array(F.lit(NEEDS_REVIEW)))).otherwise(q["warnings"]),
        "needs_review": review, "points": F.when(_text(r["question_type"]) != "", A.distinct_texts(F.concat(q["points"], F.array(r["question_type"])))).otherwise(q["points"]),
        "candidate_answer": _or(answer, q["candidate_answer"]), "answer_confidence": answer_confidence, "answer_unknown_reason": _or(no_answer, q["answer_unknown_reason"]),
        "candidate_analysis": _or(analysis, q["candidate_analysis"]), "analysis_unknown_reason": _or(no_analysis, q["analysis_unknown_reason"]),
        "reasoning": _or(_first(r["reasoning"], r["question_intent"]), q["reasoning"]),
        "visual_summary": F.when(F.size(summaries) > 0, _lines(summaries)).otherwise(q["visual_summary"]), "visual_confidence": visual_confidence,
        "visual_error": F.when(F.size(errors) > 0, _lines(errors)).otherwise(q["visual_error"]),
        "visual_status": F.when(F.size(statuses) > 0, aggregate_status(statuses)).when(F.size(visuals) > 0, F.lit("partial")).otherwise(q["visual_status"]),
        "has_visual": (F.size(visuals) > 0) | (F.size(images) > 0), "audit_status": status, "audit_verdict": verdict, "audit_summary": summary,
        "can_understand": (_text(r["question_intent"]) != "") | can_answer | (analysis != ""), "can_solve": can_solve, "ai_confidence": confidence,
        "corrections": F.concat(q["corrections"], F.array(correction.cast(CORRECTION))),
    }
    return F.struct(*[values[k].cast(t).alias(k) for k, t in STATE.items()])


#: A review's columns besides layout, page, n, question_id and question_no; visuals are structs of
#: visual_id, belongs, linked_by, link_reason, role, summary, status, confidence and error.
REVIEW = (
    "question_type", "answer", "answer_confidence", "answer_unknown_reason", "reasoning", "analysis", "analysis_unknown_reason", "question_intent", "can_answer",
    "missing_context", "audit_status", "audit_verdict", "audit_summary", "risk_flags", "review_reasons", "quality_reasons", "needs_review",
)
VISUAL = ("visual_id", "belongs", "linked_by", "link_reason", "role", "summary", "status", "confidence", "error")


def matched_reviews(questions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews with place, that of their question; those of no question go."""
    names = F.array(F.col("id"), F.col("index").cast("string"), F.concat(F.lit("q"), F.col("index").cast("string")))
    aliases = questions.select(F.col("layout").alias("_layout"), F.col("place").alias("_place"), F.explode(F.array_distinct(F.array_compact(names))).alias("_alias")).where(F.trim("_alias") != "")
    # hardly a name recurs: they are dealt as they are read, and a name's first place is found as the join's sort streams by
    first = F.row_number().over(Window.partitionBy("_layout", "_alias").orderBy(F.asc_nulls_last("_place")))
    aliases = aliases.repartition("_layout", "_alias").withColumn("_n", first).where(F.col("_n") == 1)
    number = F.concat(F.lit("q"), _text(F.col("question_no").cast("string")))
    # a review without an id is looked for by its number at once
    asked = reviews.withColumns({"_by_id": F.coalesce(F.nullif(_text(F.col("question_id")), F.lit("")), number), "_by_no": number})
    for k in ("id", "no"):
        own = aliases.select("_layout", "_alias", F.col("_place").alias(f"_at_{k}"))
        asked = asked.join(own, (F.col("layout") == F.col("_layout")) & (F.col(f"_by_{k}") == F.col("_alias")), "left").drop("_layout", "_alias")
    return asked.withColumn("place", F.coalesce("_at_id", "_at_no")).where(F.col("place").isNotNull()).drop("_by_id", "_by_no", "_at_id", "_at_no")


def reviewed(questions: DataFrame, reviews: DataFrame, visuals: DataFrame) -> DataFrame:
    """``questions`` (layout, place, unique in it, id, index, images, flags, warnings,
    needs_review and others) with all of ``STATE`` after their reviews; one without a review
    has its own values and nulls.  visuals: layout, ref and role of what the pages have."""
    own = matched_reviews(questions, reviews)
    said = F.struct("page", "n", "question_no", *REVIEW)
    each = own.select("layout", "place", "page", "n", said.alias("_r"), F.posexplode_outer("visuals").alias("_k", "_v"))
    # a review travels with its first visual; one without a visual of a name is dealt by place, not all of a layout to one task
    ref = F.nullif(F.trim("_v.visual_id"), F.lit(""))
    each = each.withColumns({"_r": F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_r")), "_ref": ref, "_at": F.when(ref.isNull(), F.col("place"))})
    known = visuals.repartition("layout", "ref").groupBy("layout", "ref").agg(F.min("role").alias("known_role"))
    known = known.select(F.col("layout").alias("_layout"), F.col("ref").alias("known_ref"), "known_role", F.lit(None).cast("long").alias("_none"))
    same = (F.col("layout") == F.col("_layout")) & F.col("_ref").eqNullSafe(F.col("known_ref")) & F.col("_at").eqNullSafe(F.col("_none"))
    each = each.join(known, same, "left")
    shown = F.when(F.col("_k").isNotNull(), F.struct(*[F.col(f"_v.{c}").alias(c) for c in VISUAL], "known_ref", "known_role"))
    told = each.groupBy("layout", "place").agg(F.array_sort(F.collect_list(F.struct("page", "n", "_k", shown.alias("_v"), "_r"))).alias("_rows"))

    def whole(x: Column) -> Column:
        of = F.filter("_rows", lambda v: v["page"].eqNullSafe(x["page"]) & v["n"].eqNullSafe(x["n"]) & v["_v"].isNotNull())
        return F.struct(*[x["_r"][c].alias(c) for c in ("page", "n", "question_no", *REVIEW)], F.transform(of, lambda v: v["_v"]).alias("visuals"))

    told = told.select("layout", "place", F.transform(F.filter("_rows", lambda x: x["_r"].isNotNull()), whole).alias("_reviews"))
    rows = questions.join(told, ["layout", "place"], "left")
    brought = {"images": F.coalesce("images", F.array().cast(STATE["images"])), "flags": F.coalesce("flags", F.array().cast("array<string>")), "warnings": F.coalesce("warnings", F.array().cast("array<string>")), "needs_review": F.coalesce("needs_review", F.lit(False))}
    empty = {"points": F.array(), "corrections": F.array()}
    start = F.struct(*[brought.get(k, empty.get(k, F.lit(None))).cast(t).alias(k) for k, t in STATE.items()])
    state = F.when(F.col("_reviews").isNull(), start).otherwise(F.aggregate("_reviews", start, lambda q, r: _applied(q, r, F.col("index"))))
    others = [c for c in questions.columns if c not in STATE]
    return rows.withColumn("_q", state).select(*others, *[F.col(f"_q.{k}").alias(k) for k in STATE])
