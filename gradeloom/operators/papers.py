"""From pages of text to questions, materials and answers: one plan, a document being the
largest thing that meets in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import arrays as A
from gradeloom.functions import text as X
from gradeloom.operators import documents as D
from gradeloom.operators import joins as J
from gradeloom.operators import scoring as S
from gradeloom.operators import windows as W
from gradeloom.operators.review import answer_text_score

# How lines of a paper begin.
ROLES = [
    ("directory", r"\.{4,}\s*\d+\s*$"),
    ("teaching", X.TEACHING),
    ("question", X.ANCHOR),
    ("material", r"^\s*(?:根据|阅读).*(?:资料|材料|图|表|回答|完成)|^\s*(?:材料|资料)[一二三四五六七八九十\d]"),
    ("option", r"^\s*[A-D]\s*[.．、]"),
    ("caption", r"^\s*(?:图|表)\s*\d+"),
]
RANGE = r"(\d{1,3})\s*[~～\-－—至到]\s*(\d{1,3})"
SECTION = r"^\s*第[一二三四五六七八九十\d]+[章节部分]"


def elements(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, line, y0 and role of each line of ``pages`` (doc_id, page, text)
    that isn't blank, with ``at``, its place in the document."""
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = pages.select("doc_id", "page", F.posexplode(kept).alias("line_no", "line"))
    return out.withColumns({"y0": F.col("line_no") * 12, "at": F.col("page").cast("long") * 1_000_000 + F.col("line_no"), "role": X.role_of(F.col("line"), ROLES)})


def without_bands(lines: DataFrame) -> DataFrame:
    """Without headers and footers: short lines that come back at the edge of many pages."""
    page = F.struct("doc_id", "page").alias("page")
    bands = D.repeated_bands(lines.select(page, "line", "y0"))
    return lines.withColumn("_t", X.without_space(F.col("line"))).join(bands.select(F.col("text").alias("_t")), "_t", "left_anti").drop("_t")


def _gathered(lines: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("at", "line", "role", "page")))
    return lines.groupBy("doc_id", "segment").agg(own.alias("own")).withColumn("head", F.col("own")[0])


def segments(lines: DataFrame) -> DataFrame:
    """A row a question or material: its first line, and all its lines in order."""
    starts = F.col("role").isin("question", "material")
    body = lines.where(~F.col("role").isin("directory"))
    return _gathered(W.segments(body, ["doc_id"], "at", starts).where(F.col("segment") > 0))


def materials(parts: DataFrame) -> DataFrame:
    """Shared materials: text, and the range of question numbers that they say they are for."""
    m = parts.where(F.col("head.role") == "material")
    text = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    m = m.select("doc_id", F.col("segment").alias("material"), text.alias("text"), F.col("head.page").alias("page_start"), F.array_max(F.transform("own", lambda x: x["page"])).alias("page_end"))
    low, high = (F.regexp_extract("text", RANGE, g).try_cast("int") for g in (1, 2))
    return m.withColumns({"low": low, "high": high})


def questions(parts: DataFrame) -> DataFrame:
    """doc_id, segment, index, stem, options, raw_text and pages of each question."""
    q = parts.where(F.col("head.role") == "question")
    of = lambda role: F.filter("own", lambda x: x["role"] == role)
    other = F.filter("own", lambda x: ~x["role"].isin("option", "teaching"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), "\n")
    stem = F.regexp_replace(joined(other), r"^\s*(?:【?\s*例\s*\d+\s*】?|第\s*\d+\s*题|\d{1,3}[．、.]|[（(]\d{1,3}[）)])\s*", "")
    pages = F.transform("own", lambda x: x["page"])
    return q.select(
        "doc_id",
        "segment",
        X.anchor_index(F.col("head.line")).alias("index"),
        X.cut_at(X.cleaned(stem), X.TEACHING).alias("stem"),
        X.option_map(joined(of("option"))).alias("options"),
        joined(F.col("own")).alias("raw_text"),
        F.array_min(pages).alias("page_start"),
        F.array_max(pages).alias("page_end"),
    )


def parsed(pages: DataFrame) -> DataFrame:
    """Questions of ``pages`` (doc_id, page, text), with the material each belongs to, what is
    wrong with it, a confidence, and whether it needs a look."""
    parts = segments(without_bands(elements(pages)))
    m = materials(parts).where(F.col("low").isNotNull()).select("doc_id", "low", "high", "material")
    q = J.range_join(questions(parts), m, ["doc_id"], "index", "low", "high", "material")
    q = W.repeats(q, ["doc_id"], "index", ["segment"])
    n = F.size("options")
    checks = {
        "repeated": F.col("is_repeat"), "is_single": F.lit(True), "n_options": n, "content": F.col("stem"), "raw_text": F.col("raw_text"),
        "material_id": F.col("material"), "material_known": F.lit(True), "unknown_images": F.lit(0), "page": F.col("page_start"),
        "page_first": F.col("page_start"), "page_last": F.col("page_end"), "n_images": F.lit(0),
    }
    q = q.withColumn("warnings", S.group_warnings(checks))
    points = S.group_points(F.col("index").isNotNull(), F.col("stem"), F.lit(True), n, F.lit(None).cast("string"), F.col("material").isNotNull(), F.lit(True), F.col("warnings"))
    q = q.withColumn("confidence", S.confidence(points, F.col("warnings"), F.col("page_end") - F.col("page_start")))
    q = q.withColumn("rejected", S.rejected_because(F.col("stem")))
    return q.withColumn("needs_review", (F.col("confidence") < 0.85) | (F.size("warnings") > 0))


def answers(pages: DataFrame) -> DataFrame:
    """doc_id, section, index, answer, analysis and a score for each answer that an answer book
    (doc_id, page, text) states: from an anchor to the next, under the latest section."""
    lines = elements(pages)
    section = F.when(F.rlike("line", F.lit(SECTION)) & (F.length("line") <= 48), F.regexp_replace("line", r"\s+", "_"))
    lines = W.carried(lines.where(F.col("role") != "directory"), ["doc_id"], "at", section, "section")
    own = _gathered_with(W.segments(lines, ["doc_id"], "at", F.col("role") == "question").where(F.col("segment") > 0), "section")
    text = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    out = own.select("doc_id", "section", "segment", X.anchor_index(F.col("head.line")).alias("index"), text.alias("text"))
    out = out.withColumns({"answer": X.stated_answer(F.col("text")), "analysis": X.stated_analysis(F.col("text"))})
    return out.withColumn("confidence", answer_text_score(F.col("answer"), F.col("analysis"), F.col("section"), F.coalesce("index", F.lit(0)), F.size(X.anchors_in(F.col("text")))).cast("double"))


def _gathered_with(lines: DataFrame, extra: str) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("at", "line", "role", "page")))
    return lines.groupBy("doc_id", "segment").agg(own.alias("own"), F.min_by(extra, "at").alias(extra)).withColumn("head", F.col("own")[0])


def answer_page(pages: DataFrame, words: tuple[str, ...] = ("参考答案", "答案"), trailing: int = 20) -> DataFrame:
    """Each document's last page, of its last twenty, that speaks of answers."""
    last = F.max("page").over(Window.partitionBy("doc_id"))
    near = pages.withColumn("_last", last).where(F.col("page") > F.col("_last") - trailing)
    return near.where(X.contains_any(F.col("text"), list(words))).groupBy("doc_id").agg(F.max("page").alias("page"))


def key_filled(parsed_: DataFrame, pages: DataFrame) -> DataFrame:
    """Parsed questions with the answers of their document's key, where there is one."""
    key = pages.join(answer_page(pages), ["doc_id", "page"], "left_semi").select("doc_id", X.answer_key(F.col("text")).alias("key"))
    return parsed_.join(key, "doc_id", "left").withColumn("answer", F.col("key")[F.col("index")]).drop("key")


def draft_paper(candidates: DataFrame, score: float = 1.0) -> DataFrame:
    """A row a document: its accepted questions in order, and the total of their scores."""
    own = F.struct("index", "stem", "options", F.lit(score).alias("score"))
    return candidates.where(F.col("rejected").isNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "stem"))).alias("items"), F.sum(own["score"]).alias("total_score"), F.count(F.lit(1)).alias("n"))


def candidate_reasons(q: dict[str, Column]) -> Column:
    """Why a candidate is not simply added, as names: q has missing_options, stem, audit,
    needs_image, n_images, flags."""
    rules = [
        ("options_missing", F.size(q["missing_options"]) > 0),
        ("stem_missing", F.coalesce(F.trim(q["stem"]), F.lit("")) == ""),
        ("audit_failed", q["audit"].isin("failed", "skipped")),
        ("audit_warning", q["audit"] == "warning"),
        ("image_missing", q["needs_image"] & (q["n_images"] == 0)),
    ]
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return A.ordered_union(own, q["flags"])


def recrop_plan(regions: DataFrame) -> DataFrame:
    """A row for each page of a question: the box around its regions (x0, y0, x1, y1), and
    whether it takes most of the page (risk)."""
    out = regions.groupBy("question", "page").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.max("height").alias("height"))
    return out.withColumn("risk", (F.col("y1") - F.col("y0")) > 0.8 * F.col("height"))
