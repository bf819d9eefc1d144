from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.operators import documents as D
from gradeloom.operators import scoring as S


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_universal_confidence(spark):
    c = lambda text, n, missing, material: value(spark, S.universal_confidence(F.lit(text), F.lit(n), F.lit(missing), F.lit(material)))
    assert c("x" * 12, 4, False, False) == 0.95
    assert c("x" * 11, 2, False, True) == 0.6
    assert c("x", 0, True, True) == 0.2


def test_answer_image_score(spark):
    c = lambda w, h, section, index, before: value(spark, S.answer_image_score(*[F.lit(float(v)) for v in (w, h, 100, 200)], F.lit(section), F.lit(index), F.lit(before).cast("int")))
    assert c(80, 50, "s", 2, 1) == 90
    assert c(80, 40, "s", 2, 3) == 60
    assert c(80, 29, "s", 2, None) == 60
    assert c(80, 190, None, 2, 3) == 60


def test_source_highlight(spark):
    page = lambda *p, rest=None: G.source_page([F.lit(x).cast("int") for x in p], F.lit(rest).cast("array<int>"))
    assert [value(spark, page(None, 0, 4)), value(spark, page(None, 0, rest=[7, 8])), value(spark, page(None))] == [4, 7, 1]
    assert tuple(value(spark, G.source_highlight(G.box(5, 6, 5, 16), F.lit(-2)))) == (1, 5.0, 6.0, 1.0, 10.0)
    assert value(spark, G.source_highlight(F.array(F.lit(1.0)), F.lit(1))) is None


def test_vision_pages(spark):
    box, far = [0.0, 0.0, 10.0, 10.0], [20.0, 20.0, 30.0, 30.0]
    questions = spark.createDataFrame(
        [
            (3, True, 0.9, None, None, None, None),
            (4, False, 0.0, 0.5, None, None, None),
            (5, False, 0.9, None, box, None, [("v", [5.0, 5.0, 20.0, 20.0])]),
            (6, False, 0.9, None, box, ["a"], [("v", far)]),
            (6, False, 0.9, None, box, ["a"], None),
            (7, False, 0.0, None, box, ["a", "b"], [("", far), (None, far)]),
        ],
        "page int, needs_review boolean, parse_confidence double, confidence double, source_bbox array<double>, image_refs array<string>, visual_refs array<struct<id: string, bbox: array<double>>>",
    )
    blocks = spark.createDataFrame([(1, "table", None), (2, "text", "见下图"), (7, "text", "无"), (8, None, None)], "page int, type string, text string")
    visuals = spark.createDataFrame([(9,)], "page int")
    got = D.vision_pages(spark.range(1, 11).select(F.col("id").cast("int").alias("page")), blocks, questions, visuals)
    assert sorted(r["page"] for r in got.where("call_vision").collect()) == [1, 2, 3, 4, 5, 6, 9]
    assert got.count() == 10
    assert {r["page"]: r["shared"] for r in D.shared_owners(questions).collect()} == {5: False, 6: True, 7: False}


def test_smoke_summary(spark):
    manifest = spark.createDataFrame(
        [
            (1, [0.0, 0.0, 100.0, 80.0], None, 6, 3, True, "m"),
            (1, [], [0.0, 0.0, 300.0, 70.0], 1, None, True, ""),
            (2, None, None, 0, None, False, None),
        ],
        "page_num int, context_bbox array<double>, question_bbox array<double>, linked_visual_count int, next_question_boundary int, accepted boolean, linked_material_id string",
    )
    crops = D.suspicious_crops(manifest, spark.createDataFrame([(1, 100)], "page_num int, height int"))
    assert sorted(r["reasons"] for r in crops.collect()) == [[], [], ["crop_height_gt_page_70_percent", "crop_width_lt_200", "linked_visual_count_gt_5", "touches_next_question_boundary"]]
    assert tuple(D.smoke_summary(crops).first()) == (3, 2, 1, 2, 200.0, 75.0, 80.0, 1)
