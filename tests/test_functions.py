from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import arrays as A
from gradeloom.functions import dates as Dt
from gradeloom.functions import geometry as G
from gradeloom.functions import numeric as N
from gradeloom.functions import text as X
from gradeloom.sources.tables import page_indexes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("  a ", "A"), (None, ""), ("对", "对")])
def test_answer(spark, text, want):
    assert one(spark, X.answer(F.lit(text).cast("string"))) == want


def test_signature_order(spark):
    """Space goes, then punctuation, then the cut, then lower case."""
    assert one(spark, X.signature(F.lit("　A b，C。\t1"))) == "abc1"
    assert one(spark, X.signature(F.lit("ab" * 400))) == "ab" * 250


def test_cleaning(spark):
    assert one(spark, X.cleaned(F.lit("【\n】】甲[image: x]乙\n![c](u)\n丙【【"))) == "甲乙\n丙"
    assert one(spark, X.without_placeholders(F.lit(None).cast("string"))) == ""
    assert one(spark, X.normalised(F.lit("a\r\nb\t\n\n\n\nc"))) == "a\nb \n\nc"
    assert one(spark, X.cut_at(F.lit("题干 思路点拨 其余"), X.TEACHING)) == "题干"


def test_significant_tokens(spark):
    got = set(one(spark, X.significant_tokens(F.lit("A. 资料 人口增长率 GDP ![x](y) b"))))
    assert {"人口增长率", "人口", "口增", "长率", "gdp"} <= got
    assert "资料" not in got and "增长" not in got


@pytest.mark.parametrize(("line", "n"), [("【例 3】题", 3), ("第 12 题", 12), ("7．甲", 7), ("7.5 米", None), ("（4）甲", 4), ("甲", None)])
def test_anchor_index(spark, line, n):
    assert one(spark, X.anchor_index(F.lit(line))) == n


def test_options_and_keys(spark):
    assert one(spark, X.option_map(F.lit("A.甲 B.乙 A.丙"))) == {"A": "甲", "B": "乙"}
    text = F.lit("1.A 2、B 1.C")
    assert one(spark, X.answer_key(text)) == {1: "A", 2: "B"}
    assert one(spark, X.answer_key(text, first=False)) == {1: "C", 2: "B"}


@pytest.mark.parametrize(("text", "want"), [("答案：B", "B"), ("故选C", "C"), ("答案 正确", "对"), ("没有", None)])
def test_stated_answer(spark, text, want):
    assert one(spark, X.stated_answer(F.lit(text))) == want


def test_small_texts(spark):
    assert one(spark, X.fenced_json(F.lit('x\n```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, X.file_name(F.lit("http://h/a/%E9%A2%98.pdf?x=1"))) == "题.pdf"
    assert one(spark, X.slug(F.lit(" a b/c "))) == "a_b_c"
    assert one(spark, X.truncated(F.lit("x" * 101))) == "x" * 100 + "..."
    assert one(spark, X.solver_answer(F.lit("b．"))) == "B"
    assert one(spark, X.letters_sum(F.lit("AB"))) == 131


def test_numbers(spark):
    assert one(spark, N.percent(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, N.percent(F.lit(1), F.lit(0))) == 0
    assert [one(spark, N.progress(F.lit(a), F.lit(b))) for a, b in ((0, 10), (5, 10), (20, 10), (1, 0))] == [15, 45, 95, 15]
    assert one(spark, N.number_or(F.lit("").cast("string"))) == 0
    assert one(spark, N.number_or(F.lit("x"), 4.0)) == 4
    assert one(spark, N.whole_or_null(F.lit("x"))) is None


def test_dates(spark):
    t = F.lit("2024-01-31 10:00:00").cast("timestamp")
    assert one(spark, Dt.start_of_week(t)) == dt.datetime(2024, 1, 29)
    assert one(spark, Dt.period_start("week", t)) == dt.datetime(2024, 1, 24)
    assert [one(spark, Dt.seconds_of(F.lit(x))) for x in ("7d", "2h", "30m", "45")] == [604800, 7200, 1800, 45]


def test_arrays(spark):
    s = lambda *v: F.array(*[F.lit(x).cast("string") for x in v])
    assert one(spark, A.numbers(s("1", "x", None, "2.5"))) == [1.0, 2.5]
    assert one(spark, A.numbers(s("x"))) is None
    assert one(spark, A.distinct_texts(s("b", " ", "a", None, "b "))) == ["b", "a"]
    assert one(spark, A.json_array(F.lit("nonsense"))) == []
    assert one(spark, A.json_object(F.lit('{"a": "1"}'))) == {"a": "1"}
    m = F.create_map(F.lit("a"), F.lit("low"), F.lit("A"), F.lit("up"), F.lit("b"), F.lit("x"), F.lit("C"), F.lit(" "))
    assert one(spark, A.upper_keys(m)) == {"A": "up", "B": "x"}
    assert one(spark, A.options_of(F.lit("1"), F.lit(" "), F.lit(None).cast("string"), F.lit("4"))) == {"A": "1", "D": "4"}
    x, y = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("a"), F.lit(None).cast("string"))
    assert one(spark, A.merged(x, y)) == {"a": "1", "b": "3"}
    assert [r["image_order"] for r in one(spark, A.renumbered(s("u", " ", "v")))] == [1, 2]


def test_geometry(spark):
    a, b = G.box(0, 0, 10, 10), G.box(5, 5, 15, 15)
    assert one(spark, G.overlap_ratio(a, b)) == 0.25
    assert one(spark, G.x_overlap(a, b)) == 0.5
    assert one(spark, G.y_gap(a, G.box(0, 30, 10, 40))) == 20
    assert one(spark, G.overlap_ratio(a, F.array(F.lit(1.0)))) == 0
    assert not one(spark, G.intersects(a, G.box(10, 0, 20, 10)))
    assert one(spark, G.intersects(a, G.box(10, 0, 20, 10), closed=True))
    assert one(spark, G.grow(a, 5, F.lit(12.0), F.lit(100.0))) == [0, 0, 12, 15]
    assert one(spark, G.most_gap(F.lit(1000.0))) == 350
    assert one(spark, G.union_of(F.array(a, b))) == [0, 0, 15, 15]
    assert one(spark, G.first_box(F.array(F.lit(1.0)), b)) == [5, 5, 15, 15]
    assert one(spark, G.faults(G.box(-1, 0, 20, 5), F.lit(10.0), F.lit(10.0))) == ["before_page", "beyond_page"]


def test_page_indexes(spark):
    assert [one(spark, page_indexes(F.lit(x))) for x in ("5", "1,3,1", "2-4, 3")] == [[5], [1, 3], [2, 3, 4]]
