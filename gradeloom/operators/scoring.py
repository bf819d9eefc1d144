"""Matching, scores and decisions, as column expressions over named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.functions.numeric import clamp

LEVELS = ((10, 0.35, 35), (6, 0.25, 25), (3, 0.15, 15))


def text_evidence(shared: Column, size: Column) -> Column:
    """Points for words in common with a question of so many."""
    share = shared / F.least(size, F.lit(30))
    out = F.lit(0)
    for least, ratio, points in reversed(LEVELS):
        out = F.when((shared >= least) & (share >= ratio), points).otherwise(out)
    return F.when(size > 0, out).otherwise(F.lit(0))


#: Questions whose pairs with sources are counted in one task.
OF_TASK = 2048


def evidence_pairs(questions: DataFrame, sources: DataFrame, q: tuple[str, str], s: tuple[str, str]) -> DataFrame:
    """Pairs of a question and a source, all with all, that have points for words in common:
    both ids, shared and evidence.  ``q`` and ``s`` name id and token list (distinct) of each
    side.  They meet by their words, so those without a common one never do."""
    (qid, qt), (sid, st) = q, s
    # a task holds the pairs of its questions: so many at most, more or less, and all in one place
    dealt = questions.select(qid, qt).repartition(-(-questions.count() // OF_TASK) or 1, qid)
    left = dealt.select(qid, F.size(qt).alias("_size"), F.explode(qt).alias("_w"))
    shared = left.join(sources.select(sid, F.explode(st).alias("_w")), "_w").groupBy(qid, sid).agg(F.count(F.lit(1)).alias("shared"), F.first("_size").alias("_size"))
    return shared.select(qid, sid, "shared", text_evidence(F.col("shared"), F.col("_size")).alias("evidence")).where(F.col("evidence") > 0)


def match_score(same_index: Column, has_section: Column, same_anchor: Column, evidence: Column, confidence: Column, candidates: Column, is_fallback: Column, anchors_agree: Column | None = None) -> Column:
    """How well an answer fits a question, 0 to 100.  An answer found by position alone fits
    its position by 60.  ``same_anchor``: both have one and it is the same; ``anchors_agree``:
    they are the same or both missing (if it isn't given, the former)."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = points(same_index, 45) + points(has_section, 10) + points(same_anchor, 20) + evidence + points(confidence >= 85, 5) + points(candidates == 1, 10)
    total = F.when(candidates > 1, F.least(total, F.lit(70))).otherwise(total)
    total = F.when((evidence < 20) & ~F.coalesce(same_anchor if anchors_agree is None else anchors_agree, F.lit(False)), F.least(total, F.lit(60))).otherwise(total)
    return F.when(is_fallback, points(same_index, 60)).otherwise(clamp(total, 0, 100)).cast("int")


def match_status(score: Column, candidates: Column, is_fallback: Column) -> Column:
    by_score = F.when((candidates == 1) & (score >= 85), F.lit("matched")).when(score >= 70, F.lit("ambiguous")).otherwise(F.lit("unmatched"))
    return F.when(is_fallback & (candidates == 0), F.lit("ignored")).when(is_fallback, F.lit("ambiguous")).otherwise(F.when(candidates == 0, F.lit("unmatched")).otherwise(by_score))


def matched_sources(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer source (source_id, bank_id, question_index, section_key, question_anchor,
    text, confidence, is_fallback) with its best question (question_id, bank_id, index_num,
    anchor, text) by score, and its status.  Candidates are the bank's questions of that index.
    Those of one anchor and text score alike: the first of them stands for all, with their number,
    so copies don't meet all with all."""
    alike = questions.groupBy("bank_id", F.col("index_num").alias("_index"), F.col("anchor").alias("_anchor"), F.col("text").alias("_text"))
    q = alike.agg(F.min("question_id").alias("question_id"), F.count("question_id").alias("_alike")).withColumn("_tokens", X.significant_tokens(F.col("_text")))
    s = sources.withColumn("_own", X.significant_tokens(F.col("text")))
    both = s.join(q, (s["bank_id"] == q["bank_id"]) & (s["question_index"] == q["_index"]), "left").drop(q["bank_id"])
    n = F.sum(F.coalesce("_alike", F.lit(0))).over(Window.partitionBy("source_id"))
    both = both.withColumn("candidates", n)
    evidence = text_evidence(X.overlap(F.col("_tokens"), F.col("_own")), F.size("_tokens"))
    section = F.contains("_text", F.col("section_key"))
    score = match_score(F.col("_index") == F.col("question_index"), section, (F.col("_anchor") == F.col("question_anchor")) & (F.col("question_anchor") != ""), F.coalesce(evidence, F.lit(0)), F.col("confidence"), F.col("candidates"), F.col("is_fallback"), F.col("_anchor").eqNullSafe(F.col("question_anchor")))
    both = both.withColumn("score", F.when(F.col("question_id").isNotNull(), score).otherwise(0))
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "question_id"))
    out = both.withColumn("_n", best).where(F.col("_n") == 1)
    return out.select("source_id", "question_id", "candidates", "score", match_status(F.col("score"), F.col("candidates"), F.col("is_fallback")).alias("status"))


def completeness(content: Column, options: list[Column], audit: Column, can_solve: Column, visual: Column, reviewed: Column, warnings: Column) -> Column:
    """How much of a question is there; of two versions the better one is kept."""
    there = lambda c, n: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", n).otherwise(0)
    out = there(content, 4)
    for o in options:
        out = out + there(o, 2)
    out = out + F.when(audit == "passed", 5).when(audit == "warning", 2).otherwise(0)
    out = out + F.when(F.coalesce(can_solve, F.lit(False)), 3).otherwise(0)
    out = out + F.when(visual == "success", 2).when(visual == "partial", 1).when(visual == "failed", -1).otherwise(0)
    out = out + F.when(F.coalesce(reviewed, F.lit(False)), 2).otherwise(0)
    return out - F.coalesce(warnings, F.lit(0))


def publishable(needs_review: Column, n_warnings: Column, audit: Column, reviewed: Column, error: Column) -> Column:
    """No doubt is left; and if an audit says anything, it says passed and has no error."""
    status = F.trim(F.coalesce(audit, F.lit("")))
    blank = F.coalesce(error, F.lit("")) == ""
    signal = (status != "") | F.coalesce(reviewed, F.lit(False)) | ~blank
    return ~F.coalesce(needs_review, F.lit(False)) & (F.coalesce(n_warnings, F.lit(0)) == 0) & (~signal | ((status == "passed") & blank))


CAPS = {"multiple_question_anchors": 0.4, "options_incomplete": 0.6, "teaching_text_mixed": 0.7, "visual_hint_without_image": 0.65, "material_or_visual_missing": 0.65}


def confidence(points: Column, warnings: Column, pages_apart: Column, each: float = 0.04, most: float = 0.2) -> Column:
    """A score with caps for certain warnings and for questions over several pages, and a
    little less for each warning; 0 to 1, two decimals."""
    own = F.array_distinct(F.coalesce(warnings, F.array().cast("array<string>")))
    out = points
    for name, cap in CAPS.items():
        out = F.when(F.array_contains(own, name), F.least(out, F.lit(cap))).otherwise(out)
    out = F.when(F.coalesce(pages_apart, F.lit(0)) > 1, F.least(out, F.lit(0.6))).otherwise(out)
    return clamp(F.round(out - F.least(F.lit(most), F.lit(each) * F.size(own)), 2), 0.0, 1.0)


def group_points(has_index: Column, content: Column, is_single: Column, n_options: Column, answer: Column, has_visual: Column, has_place: Column, warnings: Column) -> Column:
    """What a parsed question scores before caps."""
    judged = F.coalesce(answer.isin("对", "错", "正确", "错误"), F.lit(False))
    options = F.when(is_single, F.when(n_options >= 4, 0.2).when(n_options >= 2, 0.1).otherwise(0.0)).otherwise(F.when(judged, 0.2).otherwise(0.1))
    visual = ~F.rlike(content, F.lit(X.VISUAL_NEEDED)) | has_visual
    out = F.when(has_index, 0.2).otherwise(0.0) + F.when(F.length(F.trim(content)) >= 12, 0.2).otherwise(0.08) + options
    out = out + F.when(visual, 0.2).otherwise(0.0) + F.when(has_place, 0.1).otherwise(0.0)
    return out + F.when(F.size(F.coalesce(warnings, F.array().cast("array<string>"))) == 0, 0.1).otherwise(0.0)


def core_points(has_index: Column, stem: Column, n_options: Column, has_visual: Column, has_box: Column) -> Column:
    """As group_points, for a block that isn't classified yet."""
    visual = ~F.rlike(stem, F.lit(X.VISUAL_NEEDED)) | has_visual
    out = F.when(has_index, 0.2).otherwise(0.0) + F.when(F.length(F.trim(stem)) >= 12, 0.2).otherwise(0.08)
    out = out + F.when(n_options >= 4, 0.2).when(n_options >= 2, 0.1).otherwise(0.0)
    return out + F.when(visual, 0.2).otherwise(0.0) + F.when(has_box, 0.1).otherwise(0.0) + 0.1


def group_warnings(q: dict[str, Column]) -> Column:
    """The names of what is wrong with a parsed question, sorted.  q has: repeated, is_single,
    n_options, content, raw_text, material_id, material_known, unknown_images, page, page_first,
    page_last, n_images."""
    raw = F.coalesce(q["raw_text"], F.lit(""))
    anchors = F.size(F.filter(X.lines(raw), lambda x: F.rlike(F.trim(x), F.lit(X.ANCHOR))))
    rules = [
        ("duplicate_question_index", q["repeated"]),
        ("options_incomplete", q["is_single"] & (q["n_options"] < 4)),
        ("content_empty", F.coalesce(q["content"], F.lit("")) == ""),
        ("material_missing", q["material_id"].isNotNull() & ~q["material_known"]),
        ("image_ref_missing", q["unknown_images"] > 0),
        ("raw_text_empty", raw == ""),
        ("multiple_question_anchors", anchors > 1),
        ("teaching_text_mixed", F.rlike(raw, F.lit(X.TEACHING))),
        ("page_range_mismatch", ~q["page"].between(q["page_first"], q["page_last"])),
        ("visual_hint_without_image", F.rlike(F.coalesce(q["content"], F.lit("")), F.lit(X.VISUAL_NEEDED)) & (q["n_images"] == 0) & q["material_id"].isNull()),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])))


def rejected_because(content: Column, toc: str = r"\.{4,}\s*\d+\s*$") -> Column:
    """Why a candidate is no question, or null."""
    heading = content.startswith("第") & (F.length(content) < 15) & F.contains(content, F.lit("章"))
    return F.when(F.length(content) < 4, F.lit("content_too_short")).when(F.rlike(content, F.lit(toc)), F.lit("toc_line")).when(heading, F.lit("chapter_heading"))


def visual_material_score(order: Column, first: Column, last: Column, page: Column, page_first: Column, page_last: Column, has_range: Column, context: Column) -> Column:
    out = F.when(order.between(first, last + 12), 45).otherwise(0) + F.when(page.between(page_first, page_last), 20).otherwise(0)
    return out + F.when(has_range, 20).otherwise(0) + F.when(F.rlike(context, F.lit("(资料|材料|图|表|统计|情况)")), 10).otherwise(0)


def visual_question_score(order: Column, first: Column, last: Column, stem: Column, shared_words: Column, hint: str = "(图|表)") -> Column:
    place = F.when(order.between(first, last), 40).when((order >= first - 4) & (order < first), 25).when((order > last) & (order <= last + 4), 10).otherwise(0)
    hinted = F.rlike(stem, F.lit(hint))
    words = F.when(hinted, 25).otherwise(0) + F.when(hinted & F.rlike(stem, F.lit("(上图|上表)")) & (order < first), 10).otherwise(0)
    distance = F.least(F.abs(order - first), F.abs(order - last))
    return place + words + F.least(F.lit(15), shared_words * 5) + F.greatest(F.lit(0), 20 - distance * 3)


def best_targets(candidates: DataFrame, visual: str, least: float = 45) -> DataFrame:
    """Each visual's target (visual, target, kind, score, covers: whether the material's range
    holds the question that competes).  If the two best differ in kind by less than 10, a
    material that covers wins.  Below ``least`` nothing is assigned."""
    w = Window.partitionBy(visual).orderBy(F.desc("score"), "kind", "target")
    own = F.struct("target", "kind", "score", "covers")
    top = candidates.withColumns({"_n": F.row_number().over(w), "_second": F.lead(own).over(w)}).where(F.col("_n") == 1)
    second = F.col("_second")
    close = (second["kind"] != F.col("kind")) & (F.abs(F.col("score") - second["score"]) < 10)
    material = F.when(F.col("kind") == "material", own).otherwise(second)
    pick = F.when(F.coalesce(close & material["covers"], F.lit(False)), material).otherwise(own)
    out = top.withColumn("_pick", pick).where(F.col("score") >= least)
    return out.select(visual, F.col("_pick.target").alias("target"), F.col("_pick.kind").alias("kind"), F.col("_pick.score").alias("score"), F.round(F.least(F.lit(1.0), F.col("_pick.score") / 100), 2).alias("confidence"))


def correction(confidence_: Column, changed: Column) -> Column:
    """What becomes of a proposed correction."""
    return F.when(changed & (confidence_ >= 0.85), F.lit("applied")).when(changed & (confidence_ >= 0.65), F.lit("suggested")).otherwise(F.lit("ignored"))


def solver_risk(answer: Column, suggested: Column, confidence_: Column, least: float = 0.7) -> Column:
    """Why a solver's answer needs a look, as names."""
    differ = (X.answer(answer) != "") & (X.solver_answer(answer) != X.solver_answer(suggested))
    rules = [("answer_conflict", differ), ("low_confidence", confidence_ < least), ("answer_missing", X.answer(suggested) == "")]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def best_of(first: Column, second: Column) -> Column:
    """Of two structs with a confidence the better one; ties keep the first."""
    return F.when(F.coalesce(second["confidence"], F.lit(-1.0)) > F.coalesce(first["confidence"], F.lit(-1.0)), second).otherwise(first)


def review_decision(page_missing: Column, not_found: Column, material_missing: Column, source_unverified: Column) -> Column:
    """Whether a person can check a candidate against its source, and why not, first rule first."""
    return (
        F.when(page_missing, F.lit("not_reviewable_missing_previous_page"))
        .when(not_found, F.lit("not_reviewable_source_unverified"))
        .when(material_missing, F.lit("not_reviewable_missing_material_group"))
        .when(source_unverified, F.lit("not_reviewable_missing_source_context"))
        .otherwise(F.lit("reviewable"))
    )


def universal_confidence(content: Column, n_options: Column, missing_options: Column, material_suspected: Column) -> Column:
    """Confidence in a question that no strategy of its own has read; 0.1 to 0.98."""
    options = F.when(n_options >= 4, 0.25).when(n_options >= 2, 0.15).otherwise(0.0)
    out = F.lit(0.55) + F.when(F.length(content) >= 12, 0.15).otherwise(0.0) + options
    out = out - F.when(F.coalesce(missing_options, F.lit(False)), 0.25).otherwise(0.0) - F.when(F.coalesce(material_suspected, F.lit(False)), 0.1).otherwise(0.0)
    return F.round(clamp(out, 0.1, 0.98), 2)


def answer_image_score(width: Column, height: Column, page_width: Column, page_height: Column, section: Column, index: Column, before: Column) -> Column:
    """How likely a crop shows one answer, 0 to 100; ``before`` is the index of the anchor
    before it on the page, null for the first.  A flat crop has 60 at most."""
    out = F.lit(40) + F.when((width > page_width * 0.6) & (height > 40), 20).otherwise(0) + F.when(F.coalesce(section, F.lit("")) != "", 10).otherwise(0)
    out = out + F.when((height >= 40) & (height <= page_height * 0.9), 10).otherwise(0) + F.when(F.coalesce(index >= before, F.lit(True)), 10).otherwise(0)
    return clamp(F.when(height < 30, F.least(out, F.lit(60))).otherwise(out), 0, 100).cast("int")
