from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import joins as J
from gradeloom.operators import mutations as M
from gradeloom.operators import paging as P
from gradeloom.operators import providers as V
from gradeloom.operators import scoring as S
from gradeloom.operators import sequential as Q
from gradeloom.operators import stats
from gradeloom.operators import versions as N
from gradeloom.operators import windows as W
from gradeloom.sources import tables as T
from gradeloom.sources import writers as K


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_wrong_book_order(spark):
    """The oldest row stands for its question; the newest attempt says where."""
    df = spark.createDataFrame([(1, 7, 10, 1), (1, 7, 40, 2), (1, 8, 20, 3), (1, 8, 30, 4)], "user int, q int, at int, id int")
    got = W.wrong_book(df, ["user"], "q", "at").orderBy(F.desc("newest")).collect()
    assert [(r["q"], r["id"], r["newest"]) for r in got] == [(7, 1, 40), (8, 3, 30)]


@pytest.mark.parametrize(("days", "want"), [(["2024-01-31", "2024-01-30"], (2, "2024-01-31")), (["2024-01-30", "2024-01-28"], (1, "2024-01-30")), (["2024-01-20"], (0, "2024-01-20"))])
def test_streak(spark, days, want):
    df = spark.createDataFrame([(1, d) for d in days], "user_id int, d string").select("user_id", F.col("d").cast("timestamp").alias("created_at"))
    r = stats.streak(df, F.lit("2024-01-31 09:00:00").cast("timestamp")).first()
    assert (r["streak_days"], r["last_active_date"]) == want


def test_range_joins(spark):
    points = spark.createDataFrame([(1, k) for k in (1, 3, 5, 9)], "page int, p int")
    ranges = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 3, 6)], "page int, ord int, low int, high int")
    got = {k: rows(J.range_join(points, ranges, ["page"], "p", "low", "high", "ord", k), "p", "ord") for k in ("first", "last")}
    assert got["first"] == [(1, 0), (3, 0), (5, 0), (9, None)]
    assert got["last"] == [(1, 0), (3, 1), (5, 1), (9, None)]


def test_asof(spark):
    left = spark.createDataFrame([(1, 1), (1, 5), (2, 1)], "g int, at int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 20, "b")], "g int, at int, v string")
    assert rows(J.following(left, right, ["g"], "at", "v", 8)) == [(1, 1, "a"), (1, 5, None), (2, 1, None)]
    assert sorted(rows(J.preceding(left, right, ["g"], "at", "v")), key=str) == sorted([(1, 1, None), (1, 5, "a"), (2, 1, None)], key=str)


@pytest.mark.parametrize(
    ("same", "section", "anchor", "evidence", "confidence", "n", "fallback", "want"),
    [(True, False, True, 35, 90, 1, False, 100), (True, False, True, 35, 90, 2, False, 70), (True, False, False, 15, 90, 1, False, 60), (True, True, True, 35, 99, 1, True, 60), (False, False, False, 0, 0, 1, True, 0)],
)
def test_match_score(spark, same, section, anchor, evidence, confidence, n, fallback, want):
    c = S.match_score(*[F.lit(x) for x in (same, section, anchor, evidence, confidence, n, fallback)])
    assert spark.range(1).select(c.alias("v")).first()["v"] == want


def test_matched_sources(spark):
    q = spark.createDataFrame([("b", "q1", 1, "x", "alpha beta gamma delta"), ("b", "q2", 2, "y", "other words here")], "bank_id string, question_id string, index_num int, anchor string, text string")
    s = spark.createDataFrame([("s1", "b", 1, "k", "x", "alpha beta gamma delta", 90.0, False), ("s2", "b", 9, "k", "z", "none", 90.0, True)], "source_id string, bank_id string, question_index int, section_key string, question_anchor string, text string, confidence double, is_fallback boolean")
    got = {r["source_id"]: (r["question_id"], r["status"]) for r in S.matched_sources(s, q).collect()}
    assert got == {"s1": ("q1", "matched"), "s2": (None, "ignored")}


def test_group_warnings(spark):
    lit = lambda v: F.lit(v)
    q = {"repeated": lit(True), "is_single": lit(True), "n_options": lit(2), "content": lit("根据下图"), "raw_text": lit("1．甲\n2．乙 思路点拨"), "material_id": lit(None).cast("string"), "material_known": lit(False), "unknown_images": lit(1), "page": lit(9), "page_first": lit(1), "page_last": lit(2), "n_images": lit(0)}
    got = spark.range(1).select(S.group_warnings(q).alias("v")).first()["v"]
    assert got == sorted(["duplicate_question_index", "options_incomplete", "image_ref_missing", "multiple_question_anchors", "teaching_text_mixed", "page_range_mismatch", "visual_hint_without_image"])


@pytest.mark.parametrize("batches", [1, 2])
def test_versions(spark, batches):
    """By signature a higher score replaces; by index it must be higher by more than 1.  A batch
    does not know the signature that came with a row which took another's place in it."""
    data = [(1, 1, "a", 5), (2, 1, "b", 6), (3, 1, "c", 7), (4, 9, "c", 8), (5, 2, None, 1), (6, None, None, None)]
    df = spark.createDataFrame([(1, o // 4 if batches == 2 else 0, o, i, sig, v) for o, i, sig, v in data], "task int, batch int, o int, i int, sig string, score int")
    got = N.settled(df, "task", "batch", "o", "i", "sig", "score")
    actions = [(r.question, r.action) for r in got.orderBy("o").collect()]
    fourth = (0, "replaced") if batches == 2 else (1, "inserted")
    n = fourth[0] + 1 if batches == 1 else 1
    assert actions == [(0, "inserted"), (0, "removed"), (0, "replaced"), fourth, (n, "inserted"), (n + 1, "inserted")]
    kept = rows(N.final_versions(got, "task", "batch", "o"), "o")
    assert kept == ([(4,), (5,), (6,)] if batches == 2 else [(3,), (4,), (5,), (6,)])
    c = N.version_counts(got, "task").first()
    assert c.detected == c.replaced + c.removed and c.saved == c.inserted + c.replaced and c.inserted + c.detected == 6


def test_versions_fold_streams(spark):
    """A task of many rows is folded batch by batch of the worker's."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).selectExpr("id % 3 AS task", "0 AS batch", "id AS o", "cast(id % 11 AS int) AS i", "cast(id % 13 AS string) AS sig", "cast(id % 17 AS int) AS score")
        got = N.settled(df, "task", "batch", "o", "i", "sig", "score").groupBy("task", "action").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = N.settled(df, "task", "batch", "o", "i", "sig", "score").groupBy("task", "action").count().collect()
    assert sorted(got) == sorted(whole) and sum(r["count"] for r in got) == 500


def test_transitions(spark):
    df = spark.createDataFrame([(1, 1, "start"), (1, 2, "retry"), (1, 3, "pause"), (1, 4, "retry"), (2, 1, "finish")], "task int, o int, event string")
    assert rows(M.final_states(df, "task", "o")) == [(1, "pending", 1), (2, "pending", 1)]


def test_split_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "ab", ["x"]), (2, 2, "c", ["y"])], "id int, n int, t string, l array<string>")
    got = M.split_in_two(df, F.col("id") == 1, "n", {"t": F.lit("a")}, {"t": F.lit("b")}, 1)
    assert rows(got, "n", "t") == [(1, "a"), (2, "b"), (3, "c")]
    assert [tuple(r) for r in M.merged_into(df, "id", 1, 2, ["t"], ["l"]).select("id", "t", "l").collect()] == [(1, "ab\nc", ["x", "y"])]


def test_sequential(spark):
    a = spark.createDataFrame([(1, x) for x in (0, 2, 4, 5, 9)], "page int, at int")
    # exactly three characters on is far enough
    assert rows(Q.kept_anchors(a, ["page"], "at"), "at") == [(0,), (4,), (9,)]
    for far, n in ((2, 1), (3, 2), (4, 2)):
        assert Q.kept_anchors(spark.createDataFrame([(1, 5), (1, 5 + far)], "page int, at int"), ["page"], "at").count() == n
    c = spark.createDataFrame([(1, 1, 0.0, "A"), (1, 2, 3.0, "B"), (1, 3, None, "x"), (1, 4, 1.0, "C"), (1, 5, 3.0, "D"), (1, 6, 0.0, "E")], "page int, o int, level double, title string")
    assert [r["path"] for r in Q.chapter_paths(c, ["page"], "o", "level", "title").orderBy("o").collect()] == ["A", "A/B", "A/B", "A/C", "A/C/D", "E"]
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 0.0, 12.0, 10.0, 20.0), (1, 50.0, 13.0, 60.0, 30.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(Q.merged_boxes(b, ["page"], 5), "n") == [(1,), (2,)]
    assert rows(Q.clustered_boxes(b, ["page"], 3), "cluster") == [(0,), (0,), (1,)]


def test_paging(spark):
    df = spark.range(10).withColumn("index_num", F.when(F.col("id") > 2, F.col("id")))
    assert [r["id"] for r in P.page(df, P.sorted_by(df, "index_num", "desc", "id"), 2, 4).collect()] == [5, 4, 3, 0]
    with pytest.raises(ValueError):
        P.sorted_by(df, "password", "asc", "id")
    with pytest.raises(ValueError):
        P.page(df, [F.col("id")], 0)


def test_providers(spark):
    def ask(row):
        if row["x"] == 2:
            raise OSError("no")
        return {"y": row["x"] + 1}

    got = {r["id"]: (r["ok"], r["answer"], r["error"]) for r in V.asked(spark.createDataFrame([(1, 1), (2, 2)], "id int, x int"), "id", ["x"], ask).collect()}
    assert got == {1: (True, json.dumps({"y": 2}), None), 2: (False, None, "OSError: no")}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a")], "index int, page int, stem string")
    assert T.resolved(df).first().asDict() == {"index_num": 1, "page_num": None, "content": "a"}
    assert T.json_artifact(spark, str(tmp_path / "none"), T.schemas()["system_configs"]).count() == 0
    assert rows(T.text_layer(spark.createDataFrame([(1, "a\n \nb"), (2, None)], "p int, t string"), "p", "t")) == [(1, 0, "a", 0), (1, 1, "b", 12)]
    made = T.made_records(spark, 3, 2)
    assert 36 <= made.count() <= 60 and rows(made) == rows(T.made_records(spark, 3, 2))
    assert T.config(spark.createDataFrame([("a", "1")], "key string, value string"), ["a", "b", "c"], {"c": "3"}, {"b": "2"}) == {"a": "1", "b": "2", "c": "3"}
    assert len(T.schemas()) == 10


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"], None)], "id int, l array<string>, n string")
    assert K.manifest(df).first().asDict() == {"id": "1", "l": '["x"]', "n": ""}
    K.csv_manifest(df, str(tmp_path / "csv"))
    K.json_bundle({"q": df}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/q")).count() == 1
    assert K.markdown_table(df.select("id")).splitlines()[-1] == "| 1 |"
    for value in ("a", "b"):
        K.replace_partition(spark.createDataFrame([(7, value)], "task int, v string"), str(tmp_path / "t"), "task")
    assert rows(spark.read.parquet(str(tmp_path / "t")), "v") == [("b",)]


def test_streaming(spark, tmp_path):
    from gradeloom.streaming.callbacks import QUESTION, callback_stream, counters, pending, saved, without_repeats

    src = tmp_path / "in"
    rows_ = [("t1", 1, k, "2024-01-01 00:00:00", f"q{k}", k, "x", 1.0) for k in range(3)] + [("t2", 1, 9, "2024-01-01 00:00:00", "q9", 9, "x", 1.0)]
    df = spark.createDataFrame(rows_, "task string, batch_no int, seq long, event_time string, temp_id string, index_num int, content string, score double")
    df.coalesce(1).write.json(str(src))
    df.coalesce(1).write.mode("append").json(str(src))  # sent twice
    stream = without_repeats(callback_stream(spark, str(src)), ["task", "temp_id"], "event_time")
    paused = spark.createDataFrame([("t2",)], "task string")
    saved(stream, str(tmp_path / "out"), str(tmp_path / "cp"), paused).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    done = spark.createDataFrame([(1,), (2,)], "page int")
    assert rows(pending(spark.range(4).select(F.col("id").cast("int").alias("page")), done, ["page"])) == [(0,), (3,)]
    q = counters(callback_stream(spark, str(src), QUESTION).withColumn("status", F.lit("done")), "event_time", "status").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").first()["done"] == 8


def test_copies_of_questions_stand_for_one(spark):
    n = 3000
    q = spark.range(n).select(F.lit("b").alias("bank_id"), F.format_string("q%05d", "id").alias("question_id"), F.lit(1).alias("index_num"), F.lit("x").alias("anchor"), F.lit("alpha beta gamma delta").alias("text"))
    s = spark.range(n).select(F.col("id").alias("source_id"), F.lit("b").alias("bank_id"), F.lit(1).alias("question_index"), F.lit("k").alias("section_key"), F.lit("x").alias("question_anchor"), F.lit("alpha beta gamma").alias("text"), F.lit(90.0).alias("confidence"), F.lit(False).alias("is_fallback"))
    out = S.matched_sources(s, q)
    # copies are counted before sources meet them
    assert "min(question_id" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.groupBy("question_id", "candidates", "score", "status").count().collect()] == [("q00000", n, 70, "ambiguous", n)]


def test_merged_boxes_of_many_pages(spark):
    b = spark.range(30_000).select((F.col("id") / 3).cast("int").alias("page"), F.lit(0.0).alias("x0"), (F.col("id") % 3 * 15.0).alias("y0"), F.lit(10.0).alias("x1"), (F.col("id") % 3 * 15.0 + 10).alias("y1"))
    out = Q.merged_boxes(b.where("id % 3 < 2").unionByName(b.where("id % 3 = 2").withColumn("y0", F.lit(90.0)).withColumn("y1", F.lit(99.0))), ["page"], 5)
    # pages stream by, none is a group of its own in pandas
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.groupBy("part", "y0", "y1", "n").count().collect()} == {(0, 0.0, 25.0, 2, 10_000), (1, 90.0, 99.0, 1, 10_000)}
    holes = spark.createDataFrame([(1, None, 0.0, 9.0, 9.0), (1, 0.0, 1.0, 9.0, 9.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.n for r in Q.merged_boxes(holes, ["page"], 5).collect()) == [1, 1]


def test_image_places_are_worked_out_once(spark):
    from gradeloom.functions import images as I

    a = F.array(*[I.image(url=F.lit(u)) for u in "abc"])
    of = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    own, other = I.moved(a, F.lit(None).cast(f"array<{I.IMAGE}>"), F.lit("b"), F.lit(7))
    assert [(i.url, i.image_order) for i in of(own)] == [("a", 1), ("c", 2)] and [(i.url, i.moved_from_question_id) for i in of(other)] == [("b", "7")]
    assert of(I.moved(a, a, F.lit("z"), F.lit(7))[1]) == of(I.ordered(a)) and len(of(I.removed(a, F.lit("z")))) == 3
    assert [i.same_visual_group_id for i in of(I.grouped(a, F.lit("b"), F.lit("g")))] == [None, "g", "g"]
    assert [i.same_visual_group_id for i in of(I.grouped(a, F.lit("c"), F.lit("g")))] == [None, None, None]
    plan = spark.range(1).select(I.removed(a, F.lit("b")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_position") == 1


def test_evidence_pairs_in_small_tasks(spark, monkeypatch):
    from gradeloom.operators import scoring

    monkeypatch.setattr(scoring, "OF_TASK", 10)
    words = [f"w{k}" for k in range(12)]
    q = spark.createDataFrame([(k, words[: 1 + k % 12]) for k in range(95)], "q long, t array<string>")
    s = spark.createDataFrame([(7, words), (8, words[:3])], "s long, t array<string>")
    got = scoring.evidence_pairs(q, s, ("q", "t"), ("s", "t"))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.q, r.s, r.shared) for r in got.collect()} == {(k, x, min(n, 1 + k % 12)) for k in range(95) for x, n in ((7, 12), (8, 3)) if min(n, 1 + k % 12) >= 3 and min(n, 1 + k % 12) / (1 + k % 12) >= 0.15}
