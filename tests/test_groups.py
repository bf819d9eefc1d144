from __future__ import annotations

from gradeloom.operators import groups as B

QUESTIONS = "page int, index int, y0 double, y1 double, bbox array<double>, material_key string"
SEEDS = "page int, seed string, type string, material_key string, y0 double, y1 double, bbox array<double>, page_height double"


def question(page, index, y, material=None):
    return (page, index, y, y + 10, [0.0, y, 100.0, y + 10], material)


def seed(page, name, kind, y, material=None, wide=50.0):
    return (page, name, kind, material, y, y + 10, [0.0, y, wide, y + 10], 200.0)


def test_material_groups(spark):
    questions = [question(1, 1, 20.0), question(1, 2, 40.0), question(1, 3, 60.0, "m"), question(1, 4, 80.0), question(2, 5, 200.0), question(2, 6, 0.0), question(3, 7, 15.0), question(3, 8, 9.0)]
    seeds = [
        seed(1, "v", "visual", 0.0), seed(1, "m", "material", 50.0, "m"), seed(2, "far", "visual", 10.0), seed(1, "flat", "visual", 30.0, wide=0.0),
        seed(3, "a", "material", 0.0, "x"), seed(3, "b", "visual", 0.0),
    ]
    got = {(r["page"], r["seed"]): r for r in B.material_groups(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(seeds, SEEDS)).collect()}
    told = {k: (r["question_indexes"], r["link_reason"], r["confidence"], r["group_id"], r["start_y"], r["end_y"], r["uncertain"]) for k, r in got.items()}
    assert told == {
        (1, "m"): ([3], "explicit_material_group", 0.72, "mg_p1_1", 50.0, 70.0, False),
        (1, "v"): ([1, 2], "downward_visual_group", 0.86, "mg_p1_2", 0.0, 50.0, False),
        (2, "far"): ([5], "downward_visual_group", 0.72, None, 10.0, 210.0, True),
        (3, "b"): ([7], "downward_visual_group", 0.72, "mg_p3_1", 0.0, 25.0, False),
    }
    assert got[1, "v"]["bbox"] == [0.0, 0.0, 100.0, 50.0] and got[2, "far"]["warnings"] == ["material_group_range_uncertain"]
    assert B.material_groups(spark.createDataFrame([], QUESTIONS), spark.createDataFrame(seeds, SEEDS)).count() == 0


def test_run_summary(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(
        [("r", 3, "failed", None, 0), ("r", 1, "ok", ["vision_page_timeout"], 2), ("r", 2, "ok", ["x"], 3), ("r", None, "failed", None, None), ("s", 1, None, ["visual_model_failed"], None)],
        "run string, page_num int, request_status string, page_warnings array<string>, n int",
    )
    got = {r["run"]: tuple(r)[1:] for r in B.run_summary(pages, "run", F.col("n")).collect()}
    assert got == {"r": (4, [0], [0, 2], 5), "s": (1, [], [0], 0)}
