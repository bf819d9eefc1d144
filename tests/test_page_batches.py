"""Batches of pages by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import page_batches as B

LONG = "x" * 100


def frame(spark, texts, doc=1):
    return spark.createDataFrame([(doc, k, t) for k, t in enumerate(texts)], "doc int, page int, text string")


def test_a_question_over_the_border_comes_once(spark):
    texts = ["1、" + LONG, "a", None, "b", "2、begins", "goes on\nand ends\n3、" + LONG, *[""] * 4, "tail of 3", "", "", "", "4、" + LONG]
    got = {r.batch: r.text for r in B.batches(frame(spark, texts)).collect()}
    assert got[0].endswith("2、begins\ngoes on\nand ends") and got[1].startswith("3、") and "tail of 3" in got[1] and got[2].lstrip().startswith("4、")
    whole = "\n".join(got.values())
    assert all(whole.count(f"{n}、") == 1 for n in (1, 2, 3, 4))

    def parse(batches):
        found = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+)、"), F.lit(1)).cast("array<int>"))
        return batches.select("doc", found.alias("index")).withColumn("answer", F.when(F.col("index") == 2, F.lit("Z")))

    pages = frame(spark, [*texts, "参考答案\n1. A 2. B （3）√ 3、错 1、C"])
    assert sorted((r["index"], r.answer) for r in B.parsed(pages, parse).collect()) == [(1, "A"), (2, "Z"), (3, "错"), (4, None)]


def test_text_without_marks_stays(spark):
    got = {r.batch: r.text for r in B.batches(frame(spark, [LONG, *[""] * 4, LONG, *[""] * 4, "short"])).collect()}
    assert sorted(got) == [0, 1] and got[0].strip() == LONG
    assert B.batches(frame(spark, [])).count() == 0


def test_answer_start(spark):
    late = [""] * 30
    late[10], late[11] = "参考答案", "答案解析"
    assert B.with_answer_start(frame(spark, late)).first().answer_start == 11
    late[11] = ""
    assert B.with_answer_start(frame(spark, late)).first().answer_start is None  # page 10 is before the last 19
    assert B.with_answer_start(frame(spark, ["参考答案", ""])).first().answer_start is None
