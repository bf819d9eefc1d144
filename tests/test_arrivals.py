from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import arrivals as V


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_full_texts(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "doc int, n int, t string")
    assert {r["doc"]: r["text"] for r in V.full_texts(pages, "doc", "n", "t").collect()} == {1: "a\nb\n", 2: ""}


def test_tasks(spark):
    rows = spark.createDataFrame([(1, 7, 10), (2, 8, 30), (3, None, 20), (4, 7, 40)], "id int, bank int, at int")
    banks = spark.createDataFrame([(7, "x")], "bank int, name string")
    assert [(r["id"], r["name"]) for r in V.tasks(rows, banks, "bank", "at").collect()] == [(4, "x"), (2, None), (3, None), (1, "x")]
    assert [r["id"] for r in V.tasks(rows, banks, "bank", "at", 7).collect()] == [4, 1]


def test_sorted_candidates(spark):
    block = ("image", V.FALLBACK_TEXT, V.FALLBACK_ANCHOR + "3")
    rows = spark.createDataFrame(
        [(1, "a", 1, *block), (2, "a", 2, *block), (3, "a", None, *block), (4, "b", None, *block), (5, "a", 2, "text", *block[1:]), (6, None, 2, "image", None, None), (7, "a", 2, "image", V.FALLBACK_TEXT, None), (8, "a", 2, None, None, None)],
        "id int, bank_id string, question_index int, parse_mode string, raw_text string, question_anchor string",
    )
    questions = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), (None, 2)], "bank_id string, index_num int")
    got = {r["id"]: (r["kept"], r["parse_mode"], r["question_index"]) for r in V.sorted_candidates(rows, questions).collect()}
    assert [k for k, v in sorted(got.items()) if not v[0]] == [2, 3]
    assert got[4] == (True, "image", 0) and got[8][1] == "text" and len(got) == 8


def test_repair_proposal(spark):
    r = one(spark, V.repair_proposal(F.lit('{"options": "A", "confidence": "NaN", "visual_refs": ["v"]}'), F.lit("stem")))
    assert (r["content"], r["options"]["A"], r["confidence"], r["visual_refs"], r["warnings"]) == ("stem", "", 0.0, ["v"], ["options_missing"])
    r = one(spark, V.repair_proposal(F.lit('{"content": "夸夸刷", "options": {"A": "1", "a": "2", "b": "3", "C": "4", "D": " "}, "confidence": 2, "remove_texts": ["t"]}'), F.lit("stem")))
    assert (list(r["options"]), r["confidence"], r["remove_texts"], r["persisted"]) == (["1", "3", "4", " "], 2.0, ["t"], False)
    assert r["warnings"] == ["header_footer_blacklist_hit", "options_missing"]
    assert one(spark, V.repair_proposal(F.lit(None).cast("string"), F.lit(None).cast("string")))["content"] == ""


def test_vision_page(spark):
    strings = lambda *v: F.array(*[F.lit(x).cast("string") for x in v]).cast("array<string>")
    null = F.lit(None).cast("array<string>")
    r = one(spark, V.vision_page(F.lit("cover"), strings("m", None), strings(None, "q"), null, strings(), strings("z", None, "", "z")))
    assert (r["page_type"], r["materials"], r["questions"], r["visuals"], r["semantic_questions"]) == ("unknown", ["m"], ["q"], [], ["q"])
    assert r["warnings"] == ["semantic_questions_missing_use_questions_fallback", "visual_materials_dropped", "visual_questions_dropped", "z"]
    assert (r["input_question_count"], r["normalized_question_count"], r["dropped_question_count"], r["input_visual_count"]) == (2, 1, 1, 0)
    r = one(spark, V.vision_page(F.lit("toc"), null, strings("q"), strings("v"), strings("s", None), null))
    assert (r["page_type"], r["semantic_questions"], r["warnings"], r["dropped_visual_count"]) == ("toc", ["s"], [], 0)
