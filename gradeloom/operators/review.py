"""Review of parsed questions: which need a look, which are solved, published or added to a paper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What students don't see of a question.
STUDENTS_DONT_SEE = (
    "answer",
    "analysis",
    "analysis_image_url",
    "answer_source_id",
    "analysis_match_confidence",
    "ai_candidate_answer",
    "ai_candidate_analysis",
    "ai_answer_confidence",
    "ai_reasoning_summary",
    "ai_knowledge_points",
    "ai_risk_flags",
    "ai_solver_provider",
    "ai_solver_model",
    "ai_solver_first_model",
    "ai_solver_final_model",
    "ai_solver_rechecked",
    "ai_solver_recheck_reason",
    "ai_solver_recheck_result",
    "ai_solver_created_at",
    "ai_answer_conflict",
    "ai_action_logs",
)
#: Words of a question that a reasoning model is better at.
REASONER_WORDS = ("数量关系", "判断推理", "资料分析", "图形推理", "表格", "图表", "统计表", "增长率", "同比", "环比")
#: A text that depends on a material says one of these.
MATERIAL_WORDS = ("资料", "材料", "图表", "表格", "数据", "同比", "比重", "收入", "增长额", "判断", "计算", "固定数据", "移动数据")
#: Words of a question that speaks of an image.
IMAGE_WORDS = ("[图表]", "[图片]", "见图", "如下图")
#: Noise of headers and footers.
HEADER_NOISE = r"资料分析题库|夸夸刷|第[一二三四五六七八九十百千万\d]+章"


def yes(c: Column) -> Column:
    """False where it isn't known."""
    return F.coalesce(c, F.lit(False))


def filled(c: Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(c, F.lit("")) != ""


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [yes(c) for c in conditions])


def says(text: Column, words: tuple[str, ...]) -> Column:
    return any_of(*[F.contains(text, F.lit(w)) for w in words])


def names(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(yes(c), F.lit(n)) for n, c in rules]))


def for_students(questions: DataFrame) -> DataFrame:
    return questions.drop(*STUDENTS_DONT_SEE)


def without_password(users: DataFrame) -> DataFrame:
    return users.drop("password")


def to_solve(needs_review: Column, n_visuals: Column, n_corrections: Column, scope: str = "review_only") -> Column:
    """Whether the solver looks at a question."""
    return F.lit(True) if scope == "all" else any_of(needs_review, n_visuals > 0, n_corrections > 0)


def model_for(n_visuals: Column, needs_review: Column, conflict: Column, n_warnings: Column, n_corrections: Column, text: Column) -> Column:
    """Which model solves a question first; ``text`` is its content, material and notes."""
    hard = any_of(n_visuals > 0, needs_review, conflict, n_warnings > 0, n_corrections > 0, says(text, REASONER_WORDS))
    return F.when(hard, F.lit("reasoner")).otherwise(F.lit("fast"))


def low_confidence(confidence: Column, least: float = 0.7) -> Column:
    return yes(~F.isnan(confidence) & (confidence < least))


def high_risk(flags: Column) -> Column:
    return yes(F.arrays_overlap(flags, F.array(*[F.lit(x) for x in ("missing_context", "requires_table", "requires_chart")])))


def workbench(conflict: Column, confidence: Column, rechecked: Column, last_action: Column, suggestions: list[Column], flags: Column, candidates: list[Column]) -> dict[str, Column]:
    """Which of the workbench's queues a question is in; ``suggestions`` are all texts that show
    that a model has said something, ``candidates`` those that hold an answer or analysis."""
    acted = filled(last_action)
    return {
        "conflict": yes(conflict),
        "low_confidence": low_confidence(confidence),
        "rechecked": yes(rechecked),
        "ignored": yes(last_action == "ignore_ai_suggestion"),
        "unreviewed": any_of(*[filled(s) for s in suggestions]) & ~acted,
        "high_risk": high_risk(flags),
        "unresolved": ~acted & any_of(conflict, low_confidence(confidence), high_risk(flags), *[filled(c) for c in candidates]),
    }


def candidate_tabs(can_add: Column, manual: Column, audit: Column, n_images: Column, visual_risk: Column, answer: Column, analysis: Column) -> dict[str, Column]:
    """Which tabs of a paper's review show a candidate."""
    return {
        "addable": yes(can_add),
        "manual": yes(manual),
        "failed": yes(audit == "failed"),
        "visual": any_of(n_images > 0, visual_risk),
        "no_answer": ~filled(answer),
        "no_analysis": ~filled(analysis),
    }


def batch_publishable(needs_review: Column, status: Column) -> Column:
    return ~yes(needs_review) & (status != "published")


def options_by_type(type_: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Options by label: A and B of a judgement, else A to D; missing ones are empty."""
    text = lambda x: F.coalesce(x, F.lit(""))
    two = F.create_map(F.lit("A"), text(a), F.lit("B"), text(b))
    return F.when(type_ == "judge", two).otherwise(F.map_concat(two, F.create_map(F.lit("C"), text(c), F.lit("D"), text(d))))


def missing_options(options: list[Column]) -> Column:
    """The labels, from A, of options that are blank."""
    return names(*[("ABCD"[k], F.trim(F.coalesce(o, F.lit(""))) == "") for k, o in enumerate(options)])


def readability(content: Column, type_: Column, options: list[Column], n_warnings: Column, n_images: Column | None = None, material: Column | None = None) -> Column:
    """What keeps a question from being read: readable, score, reasons, prompts and focus areas.
    With images and material a text that speaks of an image needs one of them."""
    text, missing = F.trim(F.coalesce(content, F.lit(""))), missing_options(options)
    rules = [
        (F.length(text) < 12, F.lit("题干过短或缺失"), "重新框选题干区域", ["stem"]),
        ((F.coalesce(type_, F.lit("single")) != "judge") & (F.size(missing) > 0), F.concat(F.lit("选项缺失："), F.array_join(missing, ",")), "重新框选选项区域", ["options"]),
        (F.lit(n_images is not None) & says(text, IMAGE_WORDS) & ~any_of((F.lit(0) if n_images is None else n_images) > 0, filled(F.trim(material if material is not None else F.lit("")))), F.lit("题干依赖图表或材料但未检测到对应内容"), "重新框选材料区或图片区", ["material", "images"]),
        (n_warnings > 0, F.lit("存在解析警告"), "根据解析警告复查题干、选项和图片", ["warnings"]),
    ]
    listed = lambda values: F.array_compact(F.array(*values))
    reasons = listed([F.when(yes(c), r) for c, r, *_ in rules])
    return F.struct(
        (F.size(reasons) == 0).alias("readable"),
        F.when(F.size(reasons) > 0, 0.55).otherwise(0.88).alias("score"),
        reasons.alias("reasons"),
        listed([F.when(yes(c), F.lit(p)) for c, _, p, _ in rules]).alias("prompts"),
        listed([F.when(yes(c), F.lit(a)) for c, _, _, areas in rules for a in areas]).alias("focus_areas"),
    )


def material_dependent(stem: Column, flags: Column) -> Column:
    return says(F.concat_ws(" ", stem, F.array_join(flags, " ")), MATERIAL_WORDS)


def material_evidence(material: Column, n_visual: Column, n_title: Column, n_table: Column) -> Column:
    """Whether a semantic group shows the material that it depends on."""
    return filled(material) | (yes(n_visual > 0) & any_of(n_title > 0, n_table > 0))


def candidate(rows: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``rows`` with what decides about adding a candidate to a paper: ai_audit_status (put
    right), need_manual_fix, can_add_to_paper, manual_force_add_allowed and cannot_add_reason.

    ``c`` has audit, summary, unknown_reason, stem_missing, missing (labels), has_visual,
    visual_risk, flags, reviewable, context_reason and needs_review, of the candidate.
    """
    n_missing = F.size(c["missing"])
    image_missing = c["visual_risk"] & ~c["has_visual"]
    given = F.when(filled(c["audit"]), c["audit"]).otherwise(F.lit("failed"))
    excused = (given == "failed") & ~c["stem_missing"] & (n_missing == 0) & c["has_visual"] & yes(c["unknown_reason"] == "vision_ai_failed_or_unstructured_output")
    status = F.when(excused | ((given == "passed") & ~c["reviewable"]), F.lit("warning")).otherwise(given)
    failed, warning = status.isin("failed", "skipped"), status == "warning"
    manual = any_of(c["needs_review"], failed, warning, c["stem_missing"], n_missing > 0, image_missing, F.array_contains(c["flags"], "need_manual_fix"))
    summary = F.when(filled(c["summary"]), c["summary"]).otherwise(F.lit("未给出摘要"))
    reasons = F.array_compact(
        F.array(
            F.when(c["stem_missing"], F.lit("题干缺失或包含占位文本")),
            F.when(n_missing > 0, F.concat(F.lit("选项缺失: "), F.array_join(c["missing"], ","))),
            F.when(image_missing, F.lit("图表题图片或图表预览缺失")),
            F.when(failed, F.concat(F.lit("AI 预审核失败: "), summary)),
            F.when(warning & c["reviewable"], F.lit("AI 预审核 warning，需人工核验原卷后才可强制加入")),
            F.when(~c["reviewable"] & filled(c["context_reason"]), c["context_reason"]),
            F.when(F.array_contains(c["flags"], "chart_title_missing_or_unlocalized"), F.lit("图表标题缺失或未定位")),
            F.when(F.array_contains(c["flags"], "table_header_missing_or_unlocalized"), F.lit("表头缺失或未定位")),
        )
    )
    out = rows.withColumns({"ai_audit_status": status, "need_manual_fix": manual, "_reasons": reasons, "_reviewable": c["reviewable"]})
    can = (F.size("_reasons") == 0) & (F.col("ai_audit_status") == "passed") & ~F.col("need_manual_fix") & F.col("_reviewable")
    out = out.withColumn("can_add_to_paper", can).withColumn("manual_force_add_allowed", (F.col("ai_audit_status") == "warning") & F.col("_reviewable") & ~F.col("can_add_to_paper"))
    why = F.when(F.size("_reasons") > 0, F.array_join("_reasons", "；")).otherwise(F.lit("未通过自动入卷规则"))
    return out.withColumn("cannot_add_reason", F.when(~F.col("can_add_to_paper"), why)).drop("_reasons", "_reviewable")


def preaudit(rows: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``rows`` with what a question lacks of its pre-audit: ai_audit_status, can_solve,
    needs_review and ai_risk_flags.  ``c`` has audit, answer, analysis, confidence, has_visual,
    visual_failed, needs_review and flags."""
    flags = F.concat(c["flags"], F.when(c["has_visual"] & c["visual_failed"], F.array(F.lit("视觉解析失败，需人工复核"))).otherwise(F.array().cast("array<string>")))
    said, audited = any_of(filled(c["answer"]), filled(c["analysis"])), filled(c["audit"])
    warning = (F.size(flags) > 0) | yes(c["confidence"] < 0.7)
    status = F.when(audited, c["audit"]).when(said, F.when(warning, F.lit("warning")).otherwise(F.lit("passed"))).when(c["has_visual"], F.lit("failed")).otherwise(F.lit("skipped"))
    undone = F.when(~audited & ~said, F.array(F.lit("AI 预审核未完成，需人工复核"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "ai_audit_status": status,
            "can_solve": F.when(~audited, filled(c["answer"]) & filled(c["analysis"])),
            "needs_review": yes(c["needs_review"]) | (~audited & (~said | warning)),
            "ai_risk_flags": F.array_distinct(F.concat(flags, undone)),
        }
    )


def visual_defaults(images: Column) -> Column:
    """What a question's images say together: parse status, distinct summaries and errors, a line
    each, and the greatest confidence.  Images have summary, description, error and confidence."""
    own = F.coalesce(images, F.array())
    lines = lambda a: F.array_distinct(F.filter(a, filled))
    summaries = lines(F.transform(own, lambda i: F.coalesce(F.nullif(i["summary"], F.lit("")), i["description"])))
    errors = lines(F.transform(own, lambda i: i["error"]))
    error = F.when(F.size(errors) > 0, F.array_join(errors, "\n")).when(F.size(summaries) == 0, F.lit("视觉解析未返回结构化图表摘要"))
    return F.struct(
        F.when(F.size(own) == 0, F.lit("skipped")).when(F.size(summaries) > 0, F.lit("partial")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.size(summaries) > 0, F.array_join(summaries, "\n")).alias("summary"),
        F.when(F.size(own) > 0, error).alias("error"),
        F.array_max(F.transform(own, lambda i: i["confidence"])).alias("confidence"),
    )


def answer_suggestion(answer: Column, confidence: Column) -> Column:
    """A model's answer if it is one of A to D, and its confidence if that is a number."""
    a = F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    return F.struct(F.when(a.isin("A", "B", "C", "D"), a).alias("answer"), F.trim(confidence).try_cast("double").alias("confidence"))


def parse_stats(questions: DataFrame, group: str, total: Column, needs_review: Column, n_images: Column) -> DataFrame:
    """Of candidates that a parser found, by ``group``: how many are kept (``total`` holds), need
    review and have images, how many were found and rejected, and whether it failed."""
    count = lambda c: F.count_if(yes(c))
    out = questions.groupBy(group).agg(count(total).alias("total"), count(total & yes(needs_review)).alias("needs_review"), count(total & (n_images > 0)).alias("with_images"), F.count(F.lit(1)).alias("candidates"))
    return out.withColumn("rejected", F.greatest(F.lit(0), F.col("candidates") - F.col("total"))).withColumn("has_images", F.col("with_images") > 0).withColumn("zero_questions", F.col("total") == 0)


def answer_book_stats(answers: DataFrame, group: str, confidence: str) -> DataFrame:
    return answers.groupBy(group).agg(F.count(F.lit(1)).alias("total_candidates"), F.round(F.avg(confidence), 1).alias("avg_confidence"))


def call_stats(calls: DataFrame, group: str, order: str) -> DataFrame:
    """Of calls (page, provider, model) by ``group``: pages in order, and distinct providers and
    models in order of first sight."""
    own = calls.groupBy(group, "provider", "model").agg(F.min(order).alias("_first"))
    first = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.trim(c).alias("v")))), lambda x: x["v"]), filled))
    return own.groupBy(group).agg(first(F.col("provider")).alias("providers"), first(F.col("model")).alias("models"))


def quiz_review(questions: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Each question beside what its user answered: right if the record says so, or if the
    answers are the same."""
    own = records.select(key, F.col("answer").alias("_answer"), "user_answer", "is_correct")
    both = questions.join(own, key, "left")
    right = F.coalesce(F.nullif(F.col("_answer"), F.lit("")), F.nullif(F.col("answer"), F.lit("")), F.lit(""))
    user = F.coalesce(F.nullif(F.col("user_answer"), F.lit("")), F.lit(""))
    return both.select(key, right.alias("answer"), user.alias("user_answer"), (yes(F.col("is_correct")) | (right == user)).alias("is_correct"))


def quiz_result(answers: DataFrame, group: str, user_answer: Column, correct: Column) -> DataFrame:
    """Correct, wrong and unanswered questions, and the accuracy in whole percent."""
    answered = filled(user_answer)
    out = answers.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(answered & yes(correct)).alias("correct"), F.count_if(answered & ~yes(correct)).alias("wrong"))
    return out.withColumn("unanswered", F.col("total") - F.col("correct") - F.col("wrong")).withColumn("accuracy", F.floor(F.col("correct") * 100 / F.col("total") + 0.5))


def with_material(questions: DataFrame, materials: DataFrame, key: str) -> DataFrame:
    """Questions with their material as a struct, null without one."""
    own = materials.select(F.col(key).alias("_key"), F.struct(*materials.columns).alias("material"))
    return questions.join(own, F.col(key) == F.col("_key"), "left").drop("_key")


def selected_banks(selections: DataFrame, banks: DataFrame, key: str) -> DataFrame:
    """The published banks that users have selected."""
    return selections.join(banks.where(F.col("status") == "published"), key)


def source_applied(source: Column, own: Column) -> Column:
    """What a question has of a matched source: the source's, else its own, else nothing."""
    return F.coalesce(F.nullif(source, F.lit("")), F.nullif(own, F.lit("")))


def unbound(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions whose answer source is taken away: what they had of it is null again.
    ``sources``: source_id, s_answer, s_analysis, s_image of the sources taken away."""
    both = questions.join(sources, questions["answer_source_id"] == sources["source_id"], "left")
    gone = F.col("source_id").isNotNull()
    cleared = lambda own, theirs: F.when(~(gone & F.col(own).eqNullSafe(F.col(theirs))), F.col(own)).alias(own)
    kept = [c for c in questions.columns if c not in ("answer", "analysis", "image", "answer_source_id", "match_confidence")]
    return both.select(*kept, cleared("answer", "s_answer"), cleared("analysis", "s_analysis"), cleared("image", "s_image"), F.when(~gone, F.col("answer_source_id")).alias("answer_source_id"), F.when(~gone, F.col("match_confidence")).alias("match_confidence"))


def published(questions: DataFrame, publishable: Column, task: str) -> tuple[DataFrame, DataFrame]:
    """Questions of tasks, the publishable ones published, and what became of each task."""
    out = questions.withColumn("_ok", yes(publishable))
    counts = out.groupBy(task).agg(F.count_if("_ok").alias("published_count"), F.count_if(~F.col("_ok")).alias("review_count"))
    out = out.withColumns({"status": F.when(F.col("_ok"), F.lit("published")).otherwise(F.col("status")), "needs_review": F.col("needs_review") & ~F.col("_ok")})
    return out.drop("_ok"), counts.withColumn("skipped_count", F.col("review_count"))


def unlinked(questions: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Questions with the link to removed materials (column ``key``) null."""
    own = removed.select(F.col(key).alias("_gone")).distinct()
    return questions.join(own, questions[key] == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def with_log(logs: Column, action: Column, most: int | None = None) -> Column:
    """A question's action logs, the latest first, with another action."""
    out = F.array_prepend(F.coalesce(logs, F.array()), action)
    return F.slice(out, 1, most) if most else out


def first_of(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """Of rows that agree in ``key`` the first; a key with a null is a row's own."""
    names_ = [f"_k{i}" for i in range(len(key))]
    out = rows.withColumns(dict(zip(names_, key, strict=True)))
    own = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names_])
    n = F.row_number().over(Window.partitionBy(*names_, F.when(own, F.monotonically_increasing_id())).orderBy(*order))
    return out.withColumn("_n", n).where(F.col("_n") == 1).drop("_n", *names_)


def after_last_source(visuals: DataFrame, sources: DataFrame) -> DataFrame:
    """``visuals`` (page, y0) with after_last: whether it is below all that questions take of the
    page (sources: page, y1), by more than 4."""
    last = sources.groupBy("page").agg(F.max("y1").alias("_last"))
    return visuals.join(last, "page", "left").withColumn("after_last", yes(F.col("y0") > F.col("_last") + 4)).drop("_last")


def document_type(c: dict[str, Column]) -> Column:
    """What kind of document a sample of its pages shows, and how surely.  ``c`` has lines,
    toc_lines, options, questions, chapters, materials, exam_sections, image_pages and pages."""
    toc = c["toc_lines"] / F.greatest(c["lines"], F.lit(1))
    images = c["image_pages"] / F.greatest(c["pages"], F.lit(1))
    rules = [
        (c["lines"] == 0, "visual_heavy", F.lit(0.5)),
        (toc > 0.25, "textbook", F.least(F.lit(0.9), toc * 3)),
        ((c["materials"] >= 2) | (images > 0.4), "visual_heavy", F.least(F.lit(0.9), F.greatest(c["materials"] / 5, images))),
        ((c["exam_sections"] >= 2) & (c["options"] > 10), "exam_paper", F.lit(0.75)),
        ((c["options"] > F.greatest(c["questions"] * 3, F.lit(8))) & (c["chapters"] < 3), "pure_text", F.lit(0.8)),
    ]
    kind, sure = F.lit("pure_text"), F.lit(0.5)
    for holds, name, confidence in reversed(rules):
        kind, sure = F.when(holds, F.lit(name)).otherwise(kind), F.when(holds, confidence).otherwise(sure)
    return F.struct(kind.alias("type"), F.round(sure, 2).alias("confidence"))


def answer_text_score(answer: Column, analysis: Column, section: Column, index: Column, n_anchors: Column) -> Column:
    """How well a block of an answer book was read, 0 to 100."""
    length = F.length(F.coalesce(analysis, F.lit("")))
    out = F.lit(30) + F.when(filled(answer), 30).otherwise(0) + F.when(length > 0, 20).otherwise(0) + F.when(filled(section), 10).otherwise(0) + F.when(length.between(8, 3000), 10).otherwise(0)
    for holds, most in ((~filled(answer), 40), (n_anchors > 1, 60), (length == 0, 70), (index <= 0, 75)):
        out = F.when(holds, F.least(out, F.lit(most))).otherwise(out)
    return out.cast("int")


def can_merge(first: Column, second: Column, page_height: Column, questions: Column) -> Column:
    """Whether two boxes one above the other are one visual; ``questions`` are boxes on the page."""
    across = F.greatest(F.lit(0.0), F.least(first["x1"], second["x1"]) - F.greatest(first["x0"], second["x0"]))
    narrower = F.greatest(F.lit(1.0), F.least(first["x1"] - first["x0"], second["x1"] - second["x0"]))
    gap = F.greatest(F.lit(0.0), second["y0"] - first["y1"])
    return (across / narrower > 0.6) & (gap <= page_height * 0.08) & ~F.exists(questions, lambda q: q["y0"].between(first["y1"], second["y0"]))


def blocked(top: Column, bottom: Column, elements: Column) -> Column:
    """Whether a question or an option lies between two heights; elements have y0, y1 and role."""
    low, high = F.least(top, bottom), F.greatest(top, bottom)
    return F.exists(elements, lambda e: (e["y0"] >= low - 0.5) & (e["y1"] <= high + 0.5) & e["role"].isin("question", "option"))
