"""Page elements (page, line_no, line, y0) to roles, groups and statistics of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.functions import text as X
from gradeloom.functions.numeric import count_if


def page_heights(elements: DataFrame, otherwise: float = 1000.0) -> DataFrame:
    return elements.groupBy("page").agg(F.coalesce(F.max(F.col("y0") + 10), F.lit(otherwise)).alias("height"))


def repeated_bands(elements: DataFrame, top: float = 0.08, bottom: float = 0.06, most: int = 80, pages: int = 3) -> DataFrame:
    """Short texts at the top or bottom of more than so many pages: headers and footers."""
    both = elements.join(page_heights(elements), "page")
    band = (F.col("y0") <= F.col("height") * top) | (F.col("y0") + 10 >= F.col("height") * (1 - bottom))
    short = both.where(band & (F.length("line") <= most)).select(X.without_space(F.col("line")).alias("text"), "page")
    return short.groupBy("text").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") > pages)


def features(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """How often each pattern occurs in each document's text."""
    counts = [F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias(n) for n, p in patterns.items()]
    return pages.select("doc_id", *counts)


def kind_of(text_length: Column, n_pages: Column) -> Column:
    """Scanned, if there is hardly any text."""
    return F.when(text_length < F.greatest(F.lit(80), n_pages * 10), F.lit("scanned")).otherwise(F.lit("text"))


def answer_mode(hits: Column, chars: Column, kind: Column | None = None) -> Column:
    """How an answer book is read: as text if it says so often enough and isn't a scan."""
    scanned = F.lit(False) if kind is None else kind.isin("scanned_answer_book", "answer_note")
    return F.when(~scanned & (hits > 20) & (chars > 5000), F.lit("text")).otherwise(F.lit("image"))


def skip_page(text: Column, lines: Column, toc_lines: Column, answers: Column, explains: Column | None = None, options: Column | None = None, questions: Column | None = None) -> Column:
    """Pages that hold no questions: blank ones, tables of contents, answers, and, if what they
    explain is known, explanations without options and with one question at most."""
    out = (F.length(F.trim(text)) == 0) | (toc_lines / F.greatest(lines, F.lit(1)) > 0.35) | answers
    return out if explains is None else out | (explains & (options == 0) & (questions < 2))


def warning_histogram(rows: DataFrame, warnings: str) -> DataFrame:
    return rows.select(F.explode(warnings).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def repeated_values(rows: DataFrame, column: str) -> DataFrame:
    own = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return own.where(F.col("n") > 1)


def merged_versions(rows: DataFrame, key: str, order: str, texts: list[str], pages: str) -> DataFrame:
    """A key's versions as one: of each text the last that isn't blank, and all pages."""
    last = [F.max_by(c, F.when(F.trim(c) != "", F.col(order))).alias(c) for c in texts]
    return rows.groupBy(key).agg(*last, F.array_sort(F.collect_set(pages)).alias("pages"))


def summary(rows: DataFrame, key: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Counts of conditions in one pass."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), *[count_if(c).alias(n) for n, c in conditions.items()])


def shared_owners(questions: DataFrame) -> DataFrame:
    """page and shared: whether an image or a visual has more than one owner among the page's
    questions (page, image_refs, visual_refs: structs of id and bbox)."""
    images = F.transform(F.coalesce("image_refs", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("None")))
    visuals = F.filter(F.transform("visual_refs", lambda v: v["id"].cast("string")), lambda x: x != "")
    owned = questions.select("page", F.explode(F.concat(images, F.coalesce(visuals, F.array().cast("array<string>")))).alias("ref"))
    return owned.groupBy("page", "ref").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.bool_or(F.col("n") > 1).alias("shared"))


def vision_pages(pages: DataFrame, blocks: DataFrame, questions: DataFrame, visuals: DataFrame, least: float = 0.75) -> DataFrame:
    """Each of ``pages`` (page) and whether a vision model is to see it (call_vision): it has a
    picture, table or visual; a question that needs a look, is below ``least`` or overlaps its
    own visual; a visual with two owners; or a word that speaks of pictures.

    blocks: page, type, text; questions: page, needs_review, parse_confidence, confidence,
    source_bbox, image_refs, visual_refs; visuals: page."""
    words = F.rlike("text", F.lit("资料分析|图形推理|数量关系|表|图"))
    sure = F.coalesce(F.nullif("parse_confidence", F.lit(0.0)), "confidence", F.lit(1.0))
    source = F.col("source_bbox")
    overlap = F.exists("visual_refs", lambda v: G.valid(source) & G.valid(v["bbox"]) & G.intersects(source, v["bbox"]))
    asked = lambda c: F.coalesce(c, F.lit(False))
    reasons = [
        blocks.select("page", (asked(F.col("type").isin("image", "table")) | asked(words)).alias("call")),
        questions.select("page", (asked(F.col("needs_review")) | (sure < least) | asked(overlap)).alias("call")),
        shared_owners(questions).select("page", F.col("shared").alias("call")),
        visuals.select("page", F.lit(True).alias("call")),
    ]
    found = reduce(DataFrame.unionByName, reasons).groupBy("page").agg(F.bool_or("call").alias("_call"))
    return pages.join(found, "page", "left").withColumn("call_vision", asked(F.col("_call"))).drop("_call")


def suspicious_crops(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``manifest`` (page_num, context_bbox, question_bbox, linked_visual_count,
    next_question_boundary) with width and height of the crop, null if there is no box, and
    reasons: why a crop needs a look.  pages: page_num, height."""
    own = F.when(F.size("context_bbox") > 0, F.col("context_bbox")).otherwise(F.col("question_bbox"))
    side = lambda k: F.when(F.size(own) == 4, own[k + 2] - own[k])
    heights = pages.groupBy("page_num").agg(F.max("height").alias("_page"))
    out = manifest.withColumns({"width": side(0), "height": side(1)}).join(heights, "page_num", "left")
    rules = [
        ("crop_height_gt_page_70_percent", (F.col("_page") != 0) & (F.col("height") > F.col("_page") * 0.7)),
        ("crop_width_lt_200", (F.col("width") != 0) & (F.col("width") < 200)),
        ("linked_visual_count_gt_5", F.col("linked_visual_count") > 5),
        ("touches_next_question_boundary", F.col("next_question_boundary").isNotNull()),
    ]
    return out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).drop("_page")


def smoke_summary(crops: DataFrame) -> DataFrame:
    """One row of counts and crop sizes of ``suspicious_crops``, whose manifest also has
    accepted and linked_material_id."""
    some = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    return crops.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(F.col("accepted")).alias("accepted_questions"),
        F.count_if(F.coalesce("linked_material_id", F.lit("")) != "").alias("questions_with_material"),
        F.count_if(F.col("linked_visual_count") > 0).alias("questions_with_visuals"),
        some(F.avg("width")).alias("avg_crop_width"),
        some(F.avg("height")).alias("avg_crop_height"),
        some(F.max("height")).alias("max_crop_height"),
        F.count_if(F.size("reasons") > 0).alias("suspicious_crops"),
    )
