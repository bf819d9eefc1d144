"""Golden case files against the same rules in Python."""

from __future__ import annotations

import random
import re

import pytest

from gradeloom.sources import golden_cases as G

CASE = """# a case
name: "first case"
pdf: a.pdf   # where
pages: [1, 2]

questions:
  q1:
    index: 1
    expected_visuals: [v1, 'v 2', "v3"]
    expected_content_texts: []
    must_not_overlap_questions: [q2, 7, nobody]
  q2:
    index: 2
    index: 20
    expected_absorbed_texts: no list
    deeper:
      expected_child_visuals: [c]
  q1:
      index: 9
other:
"""


LINE = re.compile(r"(?P<step> *)(?P<key>[^:#]*)(?P<colon>:?)(?P<value>[^#]*)")


def entries(text):
    """(question, key, value) in order, and the line that fits nowhere."""
    out, place = [], (None, None)
    for raw in text.splitlines():
        m = LINE.match(raw)
        key, value, colon = m["key"].strip(), m["value"].strip(), bool(m["colon"])
        if not (key or value or colon):
            continue
        match len(m["step"]), place, colon:
            case 0, _, True:
                place = (None if value else key, None)
                out += [(None, key, value)] if value else []
            case 2, ("questions", _), True if not value:
                place = ("questions", key)
                out.append((key, None, None))
            case n, ("questions", str(question)), True if n > 3:
                out += [(question, key, value)] if value else []
            case _:
                return out, raw
    return out, None


def made(rng):
    lines = ["name: x", "pdf: y", "questions:", "  q1:", "  q2:", "    index: 3", "    a: [b, c]", "      b: 'c' # d", "", "   ", "# z", "other:", "  q3:", "k: v", "    empty:"]
    return "name: n\npdf: p\n" + "\n".join(rng.choice(lines) for _ in range(12))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_against_python(spark, end):
    texts = [CASE, "", "name: only", *(made(random.Random(k)) for k in range(40))]
    df = spark.createDataFrame([(str(k), t.replace("\n", end)) for k, t in enumerate(texts)] + [("null", None)], "path string, text string")
    got = {r.path: r for r in G.parsed(df).collect()}
    for k, text in enumerate(texts):
        want, bad = entries(text)
        mine = [(e.question, e.key, e["value"]) for e in got[str(k)].entries]
        assert mine[: len(want)] == want if bad else mine == want
        if bad:
            assert got[str(k)].fault == f"Unsupported case line: {bad}"
        else:
            assert (got[str(k)].fault is None) == ({"name", "pdf"} <= {x for q, x, _ in want if q is None})
    assert got["null"].fault == "case must define name and pdf"


def test_expectations(spark):
    df = spark.createDataFrame([("a", CASE.replace("other:\n", "")), ("b", "name: broken\npdf: x\n  q1:"), ("c", "name: none\npdf: x")], "path string, text string")
    got = {r.question: r for r in G.expectations(G.parsed(df)).collect()}
    assert set(got) == {"q1", "q2"} and {r.layout for r in got.values()} == {"first case"}
    one, two = got["q1"], got["q2"]
    # the second q1 replaces the first; a repeated key's last value counts
    assert (one["index"], one.expected_visuals, one.must_not_overlap_questions) == (9, None, None)
    assert (two["index"], two.expected_absorbed_texts, two.expected_child_visuals) == (20, None, ["c"])


def test_lists_and_names(spark):
    text = "name: n\npdf: p\nquestions:\n  q1:\n    index: 1\n    expected_visuals: [v1, 'v 2', \"v3\"]\n    expected_content_texts: []\n    must_not_overlap_questions: [q2, 7, nobody]\n  q2:\n    index: 20\n"
    got = {r.question: r for r in G.expectations(G.parsed(spark.createDataFrame([("a", text)], "path string, text string"))).collect()}
    assert got["q1"].expected_visuals == ["v1", "v 2", "v3"] and got["q1"].expected_content_texts == []
    assert got["q1"].must_not_overlap_questions == [7, 20] and got["q2"].must_not_overlap_questions is None


def test_long_file(spark):
    n = 30_000
    text = "name: long\npdf: a\nquestions:\n" + "".join(f"  q{k}:\n    index: {k}\n" for k in range(n))
    df = spark.createDataFrame([("a", text), ("b", "name: x\n  stray\npdf: y"), ("c", "name: x")], "path string, text string")
    rows = G.sound(df)
    assert (rows.count(), rows.where("path <> 'a'").count()) == (2 * n + 2, 0)
    assert [r["index"] for r in G.expected(rows).where(f"question IN ('q0', 'q{n - 1}')").orderBy("index").collect()] == [0, n - 1]
