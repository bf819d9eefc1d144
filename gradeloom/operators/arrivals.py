"""What arrives from models and parsers, made fit to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import paging as P

# fixed values
FALLBACK_TEXT, FALLBACK_ANCHOR = "color_note_block_fallback", "顺序题块"
NOISE = r"资料分析题库|夸夸刷|第[一二三四五六七八九十百千万\d]+章"
PAGE_TYPES = ("question", "toc", "chapter", "explanation", "mixed")

PROPOSAL = """content string, options map<string, string>, visual_refs array<string>, material_text string,
    remove_texts array<string>, warnings array<string>, confidence string"""


def _some(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _flag(condition: Column, name: str) -> Column:
    """The name in an array, or an empty array."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def full_texts(pages: DataFrame, key: str, order: str, text: str, name: str = "text") -> DataFrame:
    """A document's pages as one text, in order, a line break between; a null page is empty."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["t"]), "\n").alias(name))


def tasks(rows: DataFrame, banks: DataFrame, bank: str, at: str, bank_id=None) -> DataFrame:
    """Tasks with their bank, newest first; those of one bank if it is given."""
    return P.where_all(rows, P.equal(bank, bank_id)).join(banks, bank, "left").orderBy(F.col(at).desc())


def is_fallback(candidate_mode: Column, raw_text: Column, anchor: Column) -> Column:
    """Whether a candidate is a block that was only counted, not recognised."""
    rule = (candidate_mode == "image") & (raw_text == FALLBACK_TEXT) & F.startswith(F.coalesce(anchor, F.lit("")), F.lit(FALLBACK_ANCHOR))
    return F.coalesce(rule, F.lit(False))


def sorted_candidates(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates (bank_id, question_index, parse_mode, raw_text, question_anchor, ...) with
    ``kept``: false for a counted block whose index (null: 0) no question of the bank has.
    parse_mode becomes image or text.  questions: bank_id, index_num."""
    known = questions.select("bank_id", F.col("index_num").alias("question_index")).distinct().withColumn("_known", F.lit(True))
    rows = candidates.withColumn("question_index", F.coalesce("question_index", F.lit(0))).join(known, ["bank_id", "question_index"], "left")
    counted = is_fallback(F.col("parse_mode"), F.col("raw_text"), F.col("question_anchor"))
    mode = F.when(F.col("parse_mode") == "image", F.lit("image")).otherwise(F.lit("text"))
    return rows.withColumn("kept", ~counted | F.col("_known").isNotNull()).withColumn("parse_mode", mode).drop("_known")


def repair_proposal(json: Column, content: Column) -> Column:
    """A model's proposal as a struct with every field; what it leaves out is empty, and its
    text is the question's own.  Warnings are told once, in order."""
    value = F.from_json(json, PROPOSAL)
    option = lambda k: F.coalesce(_some(value["options"][k]), _some(value["options"][k.lower()]), F.lit(""))
    options = [option(k) for k in "ABCD"]
    text = X.cleaned(F.coalesce(_some(value["content"]), content, F.lit("")))
    lacking = options[0] == ""
    for o in options:
        lacking = lacking | (F.trim(o) == "")
    number = value["confidence"].try_cast("double")
    finite = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), number).otherwise(F.lit(0.0))
    warnings = F.concat(_list(value["warnings"]), _flag(F.rlike(text, F.lit(NOISE)), "header_footer_blacklist_hit"), _flag(lacking, "options_missing"))
    return F.struct(
        text.alias("content"), F.struct(*[o.alias(k) for k, o in zip("ABCD", options, strict=True)]).alias("options"),
        _list(value["visual_refs"]).alias("visual_refs"), F.coalesce(value["material_text"], F.lit("")).alias("material_text"),
        _list(value["remove_texts"]).alias("remove_texts"), F.array_distinct(warnings).alias("warnings"), finite.alias("confidence"), F.lit(False).alias("persisted"),
    )


def vision_page(page_type: Column, materials: Column, questions: Column, visuals: Column, semantic: Column, warnings: Column) -> Column:
    """A page's items without those that were not valid (null), with counts and warnings.  With
    no semantic questions the plain ones stand in for them."""
    lists = {"material": materials, "question": questions, "visual": visuals}
    size = lambda a: F.when(a.isNull(), F.lit(0)).otherwise(F.size(a))
    kept = {k: F.coalesce(F.array_compact(a), F.array()) for k, a in lists.items()}
    dropped = {k: size(a) - size(kept[k]) for k, a in lists.items()}
    stands_in = (size(semantic) == 0) & (size(kept["question"]) > 0)
    told = F.concat(
        F.filter(_list(warnings), lambda w: F.coalesce(w != "", F.lit(False))),
        _flag(stands_in, "semantic_questions_missing_use_questions_fallback"),
        _flag(dropped["material"] > 0, "visual_materials_dropped"), _flag(dropped["question"] > 0, "visual_questions_dropped"), _flag(dropped["visual"] > 0, "visual_regions_dropped"),
    )
    return F.struct(
        F.when(page_type.isin(*PAGE_TYPES), page_type).otherwise(F.lit("unknown")).alias("page_type"),
        *[kept[k].alias(f"{k}s") for k in lists],
        F.when(stands_in, kept["question"]).otherwise(F.coalesce(F.array_compact(semantic), F.array())).alias("semantic_questions"),
        F.array_sort(F.array_distinct(told)).alias("warnings"),
        *[size(a).alias(f"input_{k}_count") for k, a in lists.items()],
        *[size(kept[k]).alias(f"normalized_{k}_count") for k in lists],
        *[dropped[k].alias(f"dropped_{k}_count") for k in lists],
    )
