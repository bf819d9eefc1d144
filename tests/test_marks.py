from __future__ import annotations

import random
import re
import time

from gradeloom.functions import marks as K
from gradeloom.functions import text as X

TEXTS = [
    "【例 1】 甲\n例题2、乙\n第 3 题：丙\n4. 下列\n5、丁\n6 根据图\n7\n8.无空\n1. 方法总结\n第一节 ...... 12\n12345 从\n 9) x",
    "1\n2\n3",
    "7\n\n8、a",
    "",
    None,
    "1、a\n22、b",
    "3　下列\n\n\n 12、 x\r\n13、y",
]


def plain(text):
    """start, end and index of the marks kept: the longest of a place, if its line is a question's
    and the mark kept before is far enough."""
    text, at = text or "", {}
    for form in K.FORMS:
        for m in re.finditer("(?m)" + form, text):
            at.setdefault(m.start(), []).append((m.end(), int(m[1])))
    lines = {start: text[start:].partition("\n")[0].strip() for start in at}
    out = []
    for start in sorted(s for s, line in lines.items() if not re.match(f"{K.CONTENTS_LINE}|{K.HEADING_LINE}", line)):
        if not out or start >= out[-1][0] + K.NEAR:
            out.append((start, *max(at[start])))
    return out


def made(rng):
    parts = ["【例 %d】", "例题%d", "第%d题", "%d. ", "%d、", "%d 关于", "%d", "1. 目录", "\n", " ", "文", "章 .... 3", "%d)"]
    return "".join(rng.choice(parts).replace("%d", str(rng.randrange(2000))) + rng.choice(["", "\n", "\n\n", "甲乙"]) for _ in range(30))


def test_against_python(spark):
    texts = TEXTS + [made(random.Random(k)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.m for r in df.select("id", K.question_marks(df.t).alias("m")).collect()}
    for k, text in enumerate(texts):
        assert [(m.start, m.end, m["index"]) for m in got[k]] == plain(text), text
        assert all(text[m.start : m.end] == m.label for m in got[k])
    assert [m["index"] for m in got[0]] == [1, 2, 3, 4, 5, 6, 7, 9] and [m["index"] for m in got[1]] == [1, 3]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("1、a",)], "t string")
    assert "Python" not in df.select(K.question_marks(df.t))._jdf.queryExecution().executedPlan().toString()


def test_cut_at_anchors(spark):
    df = spark.createDataFrame([("x\n 1. a\nb \n第 2 题 c 例 3：d",), ("none",), ("",), (None,)], "t string")
    got = [r.p for r in df.select(X.cut_at_anchors(df.t).alias("p")).collect()]
    assert [(p["index"], p.block) for p in got[0]] == [(1, "1. a\nb"), (2, "第 2 题 c"), (3, "例 3：d")]
    assert [list(p) if p is not None else None for p in got[1:]] == [[], [], None]


def test_chapter_level(spark):
    lines = ["第一章 x", "三、乙", "12.丙", "考法三", "12. 丙丙丙丙丙", "文", "第一章" + "长" * 60, "12. 丙"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, t string")
    assert [r.v for r in df.orderBy("k").select(X.chapter_level(df.t).alias("v")).collect()] == [0, 1, 2, 3, None, None, None, 2]


def plain_anchors(text):
    """start, index and label of each form's finds; the first form's counts at one place."""
    at = {}
    for k, form in enumerate(X.ANCHORS):
        for m in re.finditer("(?m)" + form, text):
            at.setdefault(m.start(), []).append((k, int(m[1]), m[0].strip(" ")))
    return [(start, *min(at[start])[1:]) for start in sorted(at)]


def test_anchors_against_python(spark):
    parts = ["【例 3】", "例 %d：", "第 2 题", "第二题", "%d. ", "%d、", "\n", " ", "例", "【", "文é", "a.b", "12 ", "\x01\x02"]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts).replace("%d", str(rng.randrange(2000))) for _ in range(40)) for _ in range(60)]
    texts += ["\n\n  5. x\n 例 6: 例 7：", "4、\n   5、x\n\n6、"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.m for r in df.select("id", X.anchors_in(df.t).alias("m")).collect()}
    for k, text in enumerate(texts):
        assert [tuple(m) for m in got[k]] == plain_anchors(text), text


def test_one_pass_over_a_text(spark):
    df = spark.createDataFrame([("1、a",)], "t string")
    for c in (K.question_marks(df.t), X.anchors_in(df.t)):
        assert df.select(c.alias("m"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(CASE") == 1


def test_many_blank_lines(spark):
    df = spark.createDataFrame([("\n" * 100_000 + "5、a",)], "t string")
    assert [m.start for m in df.select(K.question_marks(df.t).alias("m")).first().m] == [0]


def test_numbers_between_empty_lines(spark):
    text = "5\n\n7\n\n\n \n8\n9"
    df = spark.createDataFrame([(text,)], "t string")
    assert [(m.start, m.end, m["index"]) for m in df.select(K.question_marks(df.t).alias("m")).first().m] == plain(text)


def test_many_marks(spark):
    """Marks of a long text take time as its length, nearly; not as its square."""
    lines = [f"{k % 9000}、 é some words of a line" for k in range(16_000)]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    began = time.monotonic()
    parts, marks = df.select(X.cut_at_anchors(df.t), K.question_marks(df.t)).first()
    assert time.monotonic() - began < 45
    assert [p.block for p in parts] == lines and [m["index"] for m in marks] == [p["index"] for p in parts] == [k % 9000 for k in range(16_000)]


def test_slices(spark):
    """Marks and parts are the same where they lie in several slices."""
    text = "\n".join(made(random.Random(k)) for k in range(8))
    df = spark.createDataFrame([(text,)], "t string")
    marks, parts = df.select(K.question_marks(df.t), X.cut_at_anchors(df.t)).first()
    assert [(m.start, m.end, m["index"]) for m in marks] == plain(text) and len(marks) > 60
    anchors = plain_anchors(text)
    ends = [a[0] for a in anchors[1:]] + [len(text)]
    assert len(parts) > 30
    assert [(p["index"], p.label, p.block) for p in parts] == [(a[1], a[2], text[a[0] : e].strip()) for a, e in zip(anchors, ends, strict=True)]
