from __future__ import annotations

from gradeloom.operators import golden as O

BOX, RIGHT, FAR = [0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0], [50.0, 50.0, 60.0, 60.0]
QUESTIONS = "layout string, index int, place int, content string, visual_ids array<string>, image_refs array<string>, source_bbox array<double>, source_page int"
EXPECTED = """layout string, question string, index int, expected_visuals array<string>, expected_content_texts array<string>, expected_child_visuals array<string>,
    expected_absorbed_texts array<string>, must_not_overlap_visuals array<string>, must_not_overlap_questions array<int>"""
VISUALS = """layout string, id string, bbox array<double>, raw_bbox array<double>, expanded_bbox array<double>, child_visual_ids array<string>, group_id string,
    absorbed array<struct<text: string, type: string>>"""
ELEMENTS = "layout string, page int, id string, type string, bbox array<double>, text string"
EXERCISES = "layout string, index int, place int, visual_ids array<string>"


def test_overlaid(spark):
    q = spark.createDataFrame([("a", 1, 1, "x", ["old"], None, None, 1), ("a", 1, 2, "y", None, None, None, 1), ("a", 2, 1, "z", [], None, None, 1), ("b", 1, 1, "w", None, None, None, 1), ("b", None, 1, "w", None, None, None, 1)], QUESTIONS)
    e = spark.createDataFrame([("a", 1, 1, ["u"]), ("a", 1, 2, ["v"]), ("a", 2, 1, ["v"])], EXERCISES)
    got = {(r["layout"], r["index"]): (r["content"], r["visual_ids"]) for r in O.overlaid(q, e).collect()}
    assert got == {("a", 1): ("y", ["v"]), ("a", 2): ("z", []), ("b", 1): ("w", None)}


def found(spark, expected, questions, visuals, elements):
    q = O.overlaid(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame([], EXERCISES))
    tables = spark.createDataFrame(expected, EXPECTED), q, spark.createDataFrame(visuals, VISUALS), spark.createDataFrame(elements, ELEMENTS)
    return sorted((r["question"], r["kind"], r["detail"]) for r in O.failures(*tables).collect())


def test_all_kinds(spark):
    expected = [
        ("a", "q1", 1, ["v1"], ["stem", "lost"], ["c2"], ["title"], ["v2", "v9"], [2, 9]),
        ("a", "q2", 2, ["v3"], None, None, ["title", "note"], ["v1"], None),
        ("a", "q3", 3, None, None, None, None, None, None),
        ("b", "q1", 1, None, None, None, None, None, [2]),
        ("a", "q4", 4, ["v2"], ["stem"], ["k"], ["title"], ["v3"], [2]),
    ]
    questions = [
        ("a", 1, 1, "the stem", ["v2", "v9"], ["v1"], BOX, 1),
        ("a", 2, 1, None, [], ["v3"], RIGHT, 1),
        ("a", 4, 1, "stem", ["v2"], None, FAR, 1),
        ("b", 1, 1, "x", None, None, [1.0, 1.0, 1.0, 5.0], 1),
        ("b", 2, 1, "x", None, None, BOX, 1),
    ]
    visuals = [
        ("a", "v1", RIGHT, None, None, None, None, None),
        ("a", "v2", BOX, BOX, RIGHT, ["k"], "g", [("the title", "text")]),
        ("a", "v3", BOX, BOX, None, None, "", [("A. one", "text"), ("title", "option"), (None, None)]),
    ]
    elements = [
        ("a", 1, "e1", "heading", BOX, "x"),
        ("a", 1, "e2", "text", RIGHT, " 1 2 "),
        ("a", 1, "e3", "text", RIGHT, "12345"),
        ("a", 2, "e4", "table", BOX, None),
        ("a", 1, "e5", "table", [10.0, 10.0, 12.0, 12.0], None),
    ]
    own = [("heading", "e1"), ("text", "e2")]
    assert found(spark, expected, questions, visuals, elements) == sorted(
        [
            ("q1", "visual_ids_mismatch", "v2,v9"),
            ("q1", "content_text_missing", "lost"),
            ("q1", "visual_child_ids_mismatch", "k"),
            ("q1", "visual_expansion_missing", "v9"),
            ("q1", "visual_absorbed_text_missing_for_visual", "v9: title"),
            ("q1", "source_overlaps_visual", "v2"),
            ("q1", "source_overlaps_question", "2"),
            *[("q1", "source_overlaps_banned_element", e) for _, e in own],
            ("q2", "visual_not_expanded", "v3"),
            ("q2", "visual_absorbed_text_missing_for_visual", "v3: note"),
            ("q2", "visual_absorbed_text_missing", "note"),
            ("q2", "visual_absorbed_question_or_option", "A. one"),
            ("q2", "visual_absorbed_question_or_option", "title"),
            ("q2", "source_overlaps_visual", "v1"),
            *[("q2", "source_overlaps_banned_element", e) for _, e in own],
            ("q3", "missing_question", "3"),
            ("q1", "source_bbox_missing", ""),
        ]
    )


def test_groups_and_empty_tables(spark):
    expected = [("a", "q1", 1, ["v1"], None, ["c"], None, None, None)]
    got = found(spark, expected, [("a", 1, 1, "x", ["v1"], None, BOX, 1)], [("a", "v1", BOX, None, None, ["c"], "", None)], [])
    assert got == [("q1", "visual_group_id_missing", "")]
    assert found(spark, [], [], [], []) == []
