"""Where questions begin in a text, as column expressions: each form is found by one regular
expression, and a running fold leaves out what begins too near the mark before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import let

# fixed values: forms of a question's number at a line's start, the surest first, and lines that only look like it
FORMS = (
    r"^\s*【\s*例\s*(\d{1,4})\s*】\s*",
    r"^\s*例题\s*(\d{1,4})\s*[．.、:]?\s*",
    r"^\s*第\s*(\d{1,4})\s*题\s*[．.、:]?\s*",
    r"^\s*(\d{1,4})\s*[．.。]\s+",
    r"^\s*(\d{1,4})\s*[、)]\s*",
    r"^\s*(\d{1,4})(?=\s+(?:下列|根据|关于|某|有|从|在|为|如|一个|一项|以下|材料|图|表|能够|可以|应当|不|与|将|把|对|从))\s*",
    r"^\s*(\d{1,4})\s*$",
)
CONTENTS_LINE = r"^.{1,80}(?:\.{4,}|…{2,})\s*\d+\s*$"
HEADING_LINE = r"^\d{1,2}[．.]\s*(目录|考法|方法|技巧|知识|题型|模块)"
NEAR = 3

MARK = "struct<start: int, end: int, index: int, label: string>"


def unmarked(text: Column) -> Column:
    """The text without the two characters that ``places`` marks places with, which few texts have."""
    return F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)


def root(n: Column) -> Column:
    """About the square root of a size, at least 1."""
    return F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int")


def folded(rows: Column, begin: Column, fold) -> Column:
    """What a fold collects in its state's field out.  A state is copied at each step, so slices of
    about the square root of the rows collect apart, and what was collected is copied once a slice."""

    def sliced(own: Column) -> Column:
        width = root(F.size(own))

        def one(state: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(own, k * width + 1, width), state.withField("out", begin["out"]), fold)
            return let(part, lambda p: p.withField("out", F.concat(state["out"], p["out"])))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(own) / width).cast("int")), begin, one, lambda s: s["out"])

    return let(rows, sliced)


def places(text: Column, forms: tuple[str, ...]) -> Column:
    """start, line (up to its end, if forms begin at lines' starts only) and hits, label and index
    in order of the forms, of each place where a form is, each form's finds apart from one
    another.  A form has one group, a number, and begins at a line's start or with a character
    of its own; lines end with a line feed only."""
    # one pass for all forms: a text is looked at where lines or the forms' characters begin, and passed over up to
    # the next such place, a run of white space at once; places are marked with two characters that are no white space
    # of the lines' starts in white space only the first and the last two can be a find's, as finds take what follows them.
    # (a class that leaves out characters beyond ASCII is many times slower than these two)
    chars = "|".join(sorted({f[0] for f in forms} - {"^"}))
    step = r"\n|[^\n]" + (rf"(?:[\x00-\x09\x0b-\x7f]++|(?!{chars})[^\n])*+" if chars else r"[^\n]*+")
    none = "|".join(f.replace("(\\d", "(?:\\d") for f in forms)
    looks = "".join(rf"(?:(?=({f}))|)" for f in forms)
    pattern = F.lit(rf"(?Udsm)((?:(?!{none})(?:^\s++|{step}))*+){looks}((?:^\s*\n(?=[^\S\n]*\n)|{step})?+)")
    last = 2 * len(forms) + 2
    cut = F.regexp_replace(unmarked(text), pattern, F.lit("\x01".join(f"${k}" for k in range(1, last + 1)) + "\x02"))
    rows = F.filter(F.transform(F.split(cut, "\x02"), lambda p: F.split(p, "\x01")), lambda p: F.size(p) == last)
    empty = F.array().cast("array<struct<start: int, line: string, hits: array<struct<label: string, index: int>>>>")
    ends = [f"end{k}" for k in range(len(forms))]

    def fold(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x[0])
        labels = [x[2 * k + 1] for k in range(len(forms))]
        is_hit = [(label != "") & (start >= state[e]) for label, e in zip(labels, ends, strict=True)]
        hits = [F.when(h, F.struct(label.alias("label"), x[2 * k + 2].try_cast("int").alias("index"))) for k, (h, label) in enumerate(zip(is_hit, labels, strict=True))]
        own = F.struct(start.alias("start"), F.substring_index(x[last - 1], "\n", 1).alias("line"), F.array_compact(F.array(*hits)).alias("hits"))
        moved = [F.when(h, start + F.length(label)).otherwise(state[e]).alias(e) for h, label, e in zip(is_hit, labels, ends, strict=True)]
        return F.struct((start + F.length(x[last - 1])).alias("at"), *moved, F.concat(state["out"], F.array(own)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), *[F.lit(0).alias(e) for e in ends], empty.alias("out"))
    return F.filter(folded(rows, begin, fold), lambda m: F.size(m["hits"]) > 0)


def _is_none(line: Column) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.rlike(bare, F.lit(rf"(?Ud){CONTENTS_LINE}")) | F.rlike(bare, F.lit(rf"(?Ud){HEADING_LINE}"))


def question_marks(text: Column) -> Column:
    """The marks of a text, in order; a null text has none.  Of marks at one place the longest
    counts, and one less than three characters after a kept one doesn't."""
    own = F.filter(places(F.coalesce(text, F.lit("")), FORMS), lambda m: ~_is_none(m["line"]))
    longest = lambda m: F.reduce(m["hits"], m["hits"][0], lambda a, h: F.when(F.length(h["label"]) > F.length(a["label"]), h).otherwise(a))
    ordered = F.transform(own, lambda m: F.struct(m["start"].alias("start"), longest(m).alias("hit")))
    kept = F.array().cast(f"array<{MARK}>")

    def step(state: Column, m: Column) -> Column:
        label = m["hit"]["label"]
        own = F.struct(m["start"].alias("start"), (m["start"] + F.length(label)).alias("end"), m["hit"]["index"].alias("index"), label.alias("label"))
        near = m["start"] < state["free"]
        return F.struct(F.when(near, state["free"]).otherwise(m["start"] + NEAR).alias("free"), F.when(near, state["out"]).otherwise(F.concat(state["out"], F.array(own))).alias("out"))

    return folded(ordered, F.struct(F.lit(0).alias("free"), kept.alias("out")), step)
