"""A parsed layout against what is expected of it: a row for each expectation that fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G

# fixed values
BANNED = ("caption", "heading", "image", "table")
HEADER_FOOTER = r"(?U)^(?:\d{1,4}|.*(?:资料分析题库|夸夸刷|第[一二三四五六七八九十百千万\d]+章).*)$"
QUESTION_OR_OPTION = r"(?U)^\s*(?:(?:【\s*)?例\s*\d+|第\s*\d+\s*题|[A-D][.．、])"
MOST_OVERLAP = 0.02

_STRINGS = "array<string>"


def overlaid(questions: DataFrame, exercises: DataFrame) -> DataFrame:
    """Questions (layout, index, place, visual_ids, ...), one an index, with the visuals of the
    exercise of that index where they have no list of their own (null; an empty one is a list).
    Of rows of one index the last by ``place`` counts, in both tables."""
    names = [c for c in questions.columns if c not in ("layout", "index")]
    last = lambda df, *c: df.where(F.col("index").isNotNull()).groupBy("layout", "index").agg(F.max_by(F.struct(*c), "place").alias("_r"))
    own = last(questions, *names).select("layout", "index", "_r.*")
    theirs = last(exercises, "visual_ids").select("layout", "index", F.coalesce("_r.visual_ids", F.array().cast(_STRINGS)).alias("_theirs"))
    return own.join(theirs, ["layout", "index"], "left").withColumn("visual_ids", F.coalesce("visual_ids", "_theirs")).drop("_theirs")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_STRINGS))


def _fail(kind: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


def _when(condition: Column, kind: str, detail: Column | str = "") -> Column:
    """One failure or none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_fail(kind, detail))).otherwise(F.array().cast("array<struct<kind: string, detail: string>>"))


def _each(values: Column, kind: str, detail=lambda x: x) -> Column:
    return F.transform(values, lambda x: _fail(kind, detail(x)))


def _holds(absorbed: Column, text: Column) -> Column:
    return F.exists(absorbed, lambda a: F.contains(F.coalesce(a["text"], F.lit("")), text))


def _own_failures() -> Column:
    """Failures that a question's own row, with its visuals in ``linked``, tells."""
    linked, texts = F.col("linked"), _list("expected_absorbed_texts")
    children = F.flatten(F.transform(linked, lambda v: F.coalesce(v["child_visual_ids"], F.array().cast(_STRINGS))))
    grouped = F.exists(linked, lambda v: F.coalesce(v["group_id"], F.lit("")) != "")
    expanded = lambda v: F.when(F.size(v["expanded_bbox"]) > 0, v["expanded_bbox"]).otherwise(v["bbox"])
    boxed = lambda v: G.valid(v["raw_bbox"]) & G.valid(expanded(v))
    absorbed_by = lambda v: F.coalesce(v["absorbed"], F.array().cast("array<struct<text: string, type: string>>"))
    absorbed = F.flatten(F.transform(linked, absorbed_by))
    asks = lambda a: F.coalesce(a["type"].isin("question_marker", "option"), F.lit(False)) | F.rlike(F.coalesce(a["text"], F.lit("")), F.lit(QUESTION_OR_OPTION))
    lost = F.flatten(F.transform(linked, lambda v: F.transform(F.filter(texts, lambda t: ~_holds(absorbed_by(v), t)), lambda t: F.concat(v["id"], F.lit(": "), t))))
    with_children, with_texts = F.size(_list("expected_child_visuals")) > 0, F.size(texts) > 0
    none = F.array().cast("array<struct<kind: string, detail: string>>")
    return F.concat(
        _when(F.col("actual_visuals") != _list("expected_visuals"), "visual_ids_mismatch", F.array_join("actual_visuals", ",")),
        _each(F.filter(_list("expected_content_texts"), lambda t: ~F.contains(F.coalesce("content", F.lit("")), t)), "content_text_missing"),
        _when(with_children & (children != F.col("expected_child_visuals")), "visual_child_ids_mismatch", F.array_join(children, ",")),
        _when(with_children & ~grouped, "visual_group_id_missing"),
        F.when(
            with_texts,
            F.concat(
                _each(F.filter(linked, lambda v: ~boxed(v)), "visual_expansion_missing", lambda v: v["id"]),
                _each(F.filter(linked, lambda v: boxed(v) & (v["raw_bbox"] == expanded(v))), "visual_not_expanded", lambda v: v["id"]),
                _each(lost, "visual_absorbed_text_missing_for_visual"),
                _each(F.filter(texts, lambda t: ~_holds(absorbed, t)), "visual_absorbed_text_missing"),
                _each(F.filter(absorbed, asks), "visual_absorbed_question_or_option", lambda a: F.coalesce(a["text"], F.lit(""))),
            ),
        ).otherwise(none),
        _when(~G.valid(F.col("source_bbox")), "source_bbox_missing"),
    )


def failures(expected: DataFrame, questions: DataFrame, visuals: DataFrame, elements: DataFrame) -> DataFrame:
    """layout, question, kind, detail: a row for each failure.

    expected: layout, question (unique in a layout), index, expected_visuals,
    expected_content_texts, expected_child_visuals, expected_absorbed_texts,
    must_not_overlap_visuals, must_not_overlap_questions (indexes); lists may be null.
    questions: as ``overlaid`` returns them, with content, image_refs, source_bbox, source_page.
    visuals: layout, id (unique in a layout), bbox, raw_bbox, expanded_bbox, child_visual_ids,
    group_id, absorbed (structs of text and type).  elements: layout, page, id, type, bbox, text.

    A question that isn't there has that one failure; one without a valid box none of overlaps.
    All joins are within a layout; a question's visuals are the only list that is gathered."""
    key = ["layout", "question"]
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    parsed = questions.select(
        "layout", "index", "content", "source_bbox", F.coalesce("source_page", F.lit(0)).alias("source_page"),
        F.coalesce(filled("visual_ids"), filled("image_refs"), F.array().cast(_STRINGS)).alias("actual_visuals"), F.lit(True).alias("_there"),
    )
    both = expected.join(parsed, ["layout", "index"], "left")
    known = visuals.select("layout", "id", F.struct("bbox", "raw_bbox", "expanded_bbox", "child_visual_ids", "group_id", "absorbed").alias("_v"))
    links = both.select(*key, F.posexplode("actual_visuals").alias("_n", "id"))
    links = links.join(known, ["layout", "id"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "id", "_v"))).alias("_linked"))
    parts = ("bbox", "raw_bbox", "expanded_bbox", "child_visual_ids", "group_id", "absorbed")
    flat = F.transform("_linked", lambda x: F.struct(x["id"].alias("id"), *[x["_v"][c].alias(c) for c in parts]))
    rows = both.join(links, key, "left").withColumn("linked", flat)
    rows = rows.withColumn("linked", F.coalesce("linked", F.array().cast(rows.schema["linked"].dataType)))
    own = F.when(F.col("_there"), _own_failures()).otherwise(F.array(_fail("missing_question", F.col("index").cast("string"))))
    told = rows.select(*key, F.inline(own))

    sourced = both.where(G.valid(F.col("source_bbox")))
    over = lambda c: G.valid(F.col(c)) & (G.overlap_ratio(F.col("source_bbox"), F.col(c)) > MOST_OVERLAP)
    kind = lambda k, detail: (*key, F.lit(k).alias("kind"), F.col(detail).cast("string").alias("detail"))
    on_visuals = sourced.select(*key, "source_bbox", F.explode("must_not_overlap_visuals").alias("id")).join(visuals.select("layout", "id", "bbox"), ["layout", "id"])
    others = parsed.select("layout", F.col("index").alias("_other"), F.col("source_bbox").alias("_box"), F.col("source_page").alias("_page"))
    on_questions = sourced.select(*key, "source_bbox", "source_page", F.explode("must_not_overlap_questions").alias("_other")).join(others, ["layout", "_other"])
    placed = elements.select("layout", F.coalesce("page", F.lit(0)).alias("source_page"), "id", "type", "bbox", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "").alias("_text"))
    banned = F.coalesce(F.col("type").isin(*BANNED), F.lit(False)) | F.rlike("_text", F.lit(HEADER_FOOTER))
    on_elements = sourced.select(*key, "source_bbox", "source_page").join(placed.where(banned), ["layout", "source_page"])
    found = [
        told,
        on_visuals.where(over("bbox")).select(*kind("source_overlaps_visual", "id")),
        on_questions.where((F.col("_page") == F.col("source_page")) & over("_box")).select(*kind("source_overlaps_question", "_other")),
        on_elements.where(over("bbox")).select(*kind("source_overlaps_banned_element", "id")),
    ]
    return reduce(DataFrame.unionByName, found)
