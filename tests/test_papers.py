from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import papers as P
from gradeloom.operators.scoring import matched_sources

PAGE1 = """XX公司 内部资料
目录........... 3
根据下列材料回答 1-2 题
2023年全国粮食产量稳步增长，其中稻谷产量持平。
1．2023年全国粮食产量约为多少亿斤？
A．一千亿
B．二千亿
C．三千亿
D．四千亿
2．下列说法与资料相符的是哪一项？
A．甲 B．乙
C．丙
D．丁"""
PAGE2 = """XX公司 内部资料
3．某商店打八折后价格为八十元，原价是多少？
A．一百
B．九十
思路点拨 先设未知数
3．重复的题号，其余完整，字数足够多。
A．一
B．二
C．三
D．四"""
KEY = "XX公司 内部资料\n参考答案\n1．C 2．A 3．B"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(7, 1, PAGE1), (7, 2, PAGE2), (7, 3, KEY), *((7, k, "XX公司 内部资料\n空页") for k in range(4, 7)), (8, 1, None), (8, 2, "")]
    return spark.createDataFrame(rows, "doc_id int, page int, text string")


def test_parsed(spark, pages):
    got = [r for r in P.parsed(pages.where("page < 3 or page > 3")).orderBy("segment").collect()]
    assert [r["index"] for r in got] == [1, 2, 3, 3]
    first, second, third, again = got
    assert first["stem"] == "2023年全国粮食产量约为多少亿斤？" and first["options"] == {"A": "一千亿", "B": "二千亿", "C": "三千亿", "D": "四千亿"}
    assert first["material"] is not None and first["material"] == second["material"] and third["material"] is None
    assert second["options"] == {"A": "甲", "B": "乙", "C": "丙", "D": "丁"}
    assert first["warnings"] == [] and not first["needs_review"] and first["confidence"] >= 0.85
    assert third["warnings"] == ["options_incomplete", "teaching_text_mixed"] and third["needs_review"]
    assert "duplicate_question_index" in again["warnings"]


def test_bands_go(spark, pages):
    lines = P.without_bands(P.elements(pages))
    assert lines.where(F.col("line").contains("内部资料")).count() == 0
    assert lines.where("doc_id = 8").count() == 0


def test_key(spark, pages):
    assert [tuple(r) for r in P.answer_page(pages).collect()] == [(7, 3)]
    got = P.key_filled(P.parsed(pages.where("page <> 3")), pages).orderBy("segment").collect()
    assert [r["answer"] for r in got] == ["C", "A", "B", "B"]


def test_answers_match(spark):
    book = spark.createDataFrame([(1, 1, "第一章 数量\n1．答案：B 设原价为甲，打八折后为八十元，故原价一百元\n2．故选C\n第二章 判断\n1．没有说明")], "doc_id int, page int, text string")
    got = P.answers(book).orderBy("segment").collect()
    assert [(r["index"], r["answer"], r["section"]) for r in got][:2] == [(1, "B", "第一章_数量"), (2, "C", "第一章_数量")]
    assert got[2]["answer"] is None and got[0]["confidence"] > got[2]["confidence"]
    sources = P.answers(book).where("segment = 1").select(F.lit("s").alias("source_id"), F.lit("b").alias("bank_id"), F.col("index").alias("question_index"), F.col("section").alias("section_key"), F.lit("x").alias("question_anchor"), "text", F.lit(90.0).alias("confidence"), F.lit(False).alias("is_fallback"))
    questions = spark.createDataFrame([("b", "q", 1, "x", "某商店打八折后价格为八十元，设原价为甲，原价一百元是否正确")], "bank_id string, question_id string, index_num int, anchor string, text string")
    assert matched_sources(sources, questions).first()["status"] == "matched"


def test_draft_and_reasons(spark, pages):
    draft = P.draft_paper(P.parsed(pages)).where("doc_id = 7").first()
    assert draft["n"] >= 4 and draft["total_score"] == draft["n"]
    lit = lambda v: F.lit(v)
    c = P.candidate_reasons({"missing_options": F.array(lit("A")), "stem": lit(" "), "audit": lit("failed"), "needs_image": lit(True), "n_images": lit(0), "flags": F.array(lit("x"), lit("stem_missing"))})
    assert spark.range(1).select(c.alias("v")).first()["v"] == ["options_missing", "stem_missing", "audit_failed", "image_missing", "x"]
    plan = spark.createDataFrame([(1, 1, 0.0, 10.0, 5.0, 50.0, 100.0), (1, 1, 2.0, 60.0, 9.0, 95.0, 100.0)], "question int, page int, x0 double, y0 double, x1 double, y1 double, height double")
    assert [tuple(r)[2:] for r in P.recrop_plan(plan).collect()] == [(0.0, 10.0, 9.0, 95.0, 100.0, True)]
