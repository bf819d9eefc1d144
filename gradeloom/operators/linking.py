"""Which question or material a visual belongs to.

Places are orders of elements in a document.  Of all pairs of a document only those are made
that can matter: a target counts from 45 points, and one that competes with it from more than
35, which takes nearness in order, a common page, or a stem that speaks of a picture and
shares a word with what stands around the visual.

One shuffle: a document's elements lie together and stream by in batches of whole documents,
all pairs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gradeloom.functions import text as X
from gradeloom.operators.regions import _begins, _in_groups

#: Elements of a bucket of orders; how far before a question points for distance are more than 2.
BUCKET, NEAR = 16, 6
HINT, ABOVE, OF_MATERIALS = "(图|表)", "(上图|上表)", "(资料|材料|图|表|统计|情况)"
#: A place that is not known; pairs that are made at once, or those of one visual.
FAR, MOST = 1 << 60, 2_000_000

VISUAL, QUESTION, MATERIAL, BOTTOM = range(4)
_ROW = "array<struct<part: int, id: long, page: int, page_end: int, first: long, last: long, y: double, low: long, high: long, words: array<string>, no_text: boolean, hints: boolean, above: boolean>>"


def elements(visuals: DataFrame, questions: DataFrame, materials: DataFrame | None, bottoms: DataFrame) -> DataFrame:
    """doc and, in structs of which one isn't null, what ``assigned`` takes."""
    given = {"visual": visuals, "question": questions, "material": materials, "bottom": bottoms}
    own = [df.select("doc", F.struct(*[c for c in df.columns if c != "doc"]).alias(name)) for name, df in given.items() if df is not None]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), own)


def _flat(rows: DataFrame) -> DataFrame:
    """A row for each element: part, and what the parts have, in common columns."""
    said = lambda c, p: F.coalesce(F.rlike(c, F.lit(p)), F.lit(False))
    place = lambda c, other: F.coalesce(c.cast("long"), F.lit(other))

    def row(name: str, part: int, keep: Column | None = None, **values: Column) -> Column:
        if name not in rows.columns:
            return F.lit(None)
        own = F.struct(*[values.get(c, F.lit(None)).alias(c) for c in names])
        there = F.col(name).isNotNull()
        return F.when(there if keep is None else there & keep, own.withField("part", F.lit(part)))

    names = [c.split(":")[0].strip() for c in _ROW.replace("array<string>", "texts").removeprefix("array<struct<").removesuffix(">>").split(",")]
    v, q, m, b = (F.col(c) for c in ("visual", "question", "material", "bottom"))
    parts = [
        row("visual", VISUAL, id=v["visual"], page=v["page"], first=place(v["order"], -FAR), y=v["y0"], words=X.tokens(v["context"]), no_text=v["context"].isNull(), hints=said(v["context"], OF_MATERIALS)),
        row("question", QUESTION, id=q["question"], page=q["page"], first=place(q["first"], FAR), last=place(q["last"], -FAR), low=q["index"], words=X.tokens(q["stem"]), no_text=q["stem"].isNull(), hints=said(q["stem"], HINT), above=said(q["stem"], ABOVE)),
        row("material", MATERIAL, id=m["material"], page=m["page_start"], page_end=m["page_end"], first=place(m["first"], FAR), last=place(m["last"], -FAR), low=m["low"], high=m["high"]),
        row("bottom", BOTTOM, b["bottom"].isNotNull(), page=b["page"], y=b["bottom"]),
    ]
    return rows.select("doc", F.inline(F.array_compact(F.array(*parts).cast(_ROW))))


def _codes(groups: list[np.ndarray], keys: list[np.ndarray], known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """One number for each group and key, in their order; below 0 what isn't known, alike in one list only."""
    values, dense = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    out = [g * len(values) + d for g, d in zip(groups, np.split(dense, ends), strict=True)]
    return out if known is None else [np.where(ok, c, -1 - k) for k, (c, ok) in enumerate(zip(out, known, strict=True))]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the whole numbers from low to high of each."""
    n = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


class _Join:
    """Rows of the left and the right whose codes are equal, made for some of the left's ``of``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, of: np.ndarray, to: np.ndarray, n: int):
        order = np.argsort(right, kind="stable")
        sorted_ = right[order]
        self.of, self.to = of, to[order]
        self.low = np.searchsorted(sorted_, left)
        self.n = np.searchsorted(sorted_, left, "right") - self.low
        self.ends = np.searchsorted(of, np.arange(n + 1))

    def counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.n)])[self.ends])

    def pairs(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.ends[begin], self.ends[end])
        rows, at = _spread(self.low[some], self.low[some] + self.n[some] - 1)
        return self.of[some][rows], self.to[at]


def _words(t: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' words, each's row and the word's number in the table."""
    lists = t.column("words").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    numbers = lists.flatten().dictionary_encode().indices.to_numpy()
    starts = (np.cumsum(lengths) - lengths)[rows]
    of, at = _spread(starts, starts + lengths[rows] - 1)
    return of, numbers[at]


def _assigned(t: pa.Table) -> pa.Table:
    column = lambda c, fill: t.column(c).fill_null(fill).to_numpy()
    part, group = column("part", 0), np.cumsum(_begins(t, ["doc"])) - 1
    v, q, m, b = (np.flatnonzero(part == k) for k in range(4))
    ids, first, last, y = column("id", 0), column("first", 0), column("last", 0), column("y", np.nan)
    page, paged = column("page", 0).astype(np.int64), t.column("page").is_valid().to_numpy()
    page_end, low, high = column("page_end", -(1 << 31)).astype(np.int64), column("low", FAR), column("high", -FAR)
    no_text, hints, above = (column(c, False) for c in ("no_text", "hints", "above"))
    order, begins, ends = first[v], first[q], last[q]

    # the question that follows
    of_page = _codes([group[v], group[v], group[q], group[b]], [page[v], page[v] + 1, page[q], page[b]], [paged[v], paged[v], paged[q] & (begins < FAR), paged[b]])
    mine, after, its, lowest = of_page
    _, place = np.unique(np.concatenate([order, begins]), return_inverse=True)
    sorted_ = np.lexsort((ids[q], begins, its))
    span = len(place) + 1
    at = np.searchsorted((its * span + place[len(v) :])[sorted_], mine * span + place[: len(v)], "right")
    hit = lambda at, codes, want: (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == want) if len(codes) else np.zeros(len(want), bool)
    take = lambda at: sorted_[np.minimum(at, len(q) - 1)] if len(q) else np.zeros(len(at), np.int64)
    same, next_at = hit(at, its[sorted_], mine), np.searchsorted(its[sorted_], after)
    near = same & (begins[take(at)] - order <= 8) if len(q) else same
    deep = np.lexsort((y[b], lowest))
    bottom_at = np.searchsorted(lowest[deep], mine, "right") - 1
    below = (bottom_at >= 0) & hit(np.maximum(bottom_at, 0), lowest[deep], mine)
    bottom = np.where(below, y[b][deep][np.maximum(bottom_at, 0)], np.nan) if len(b) else np.full(len(v), np.nan)
    beyond = ~same & (y[v] > bottom + 4) & hit(next_at, its[sorted_], after)
    following = np.where(near, take(at), np.where(beyond, take(next_at), -1))

    def joined(keys, others, of, to, left, right):
        a, c = _codes([group[left][of], group[right][to]], [keys, others])
        return _Join(a, c, of, to, len(v))

    every = np.arange(len(v))
    bucket = np.floor_divide(order, BUCKET)
    spread = lambda low, high: _spread(np.floor_divide(low, BUCKET), np.where(low <= high, np.floor_divide(high, BUCKET), np.floor_divide(low, BUCKET) - 1))
    q_of, q_bucket = spread(begins - NEAR, ends + NEAR)
    m_of, m_bucket = spread(first[m], last[m] + 12)
    p_of, p_page = _spread(page[m], np.where(paged[m], page_end[m], page[m] - 1))
    v_words, q_words = _words(t, v), _words(t, q)
    by_order = joined(bucket, q_bucket, every, q_of, v, q)
    by_word = joined(v_words[1], q_words[1], v_words[0], q_words[0], v, q)
    of_order, on_page = joined(bucket, m_bucket, every, m_of, v, m), joined(page[v], p_page, every, p_of, v, m)

    def scored(begin: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
        """visual, kind, target and score of pairs that can matter, kind 0 of materials."""
        size = max(1, len(q))
        x, k = by_order.pairs(begin, end)
        close = (order[x] >= begins[k] - NEAR) & (order[x] <= ends[k] + NEAR)
        given = begin + np.flatnonzero(following[begin:end] >= 0)
        near = np.unique(np.concatenate([x[close] * size + k[close], given * size + following[given]]))
        x, k = by_word.pairs(begin, end)
        words, shared = np.unique(x * size + k, return_counts=True)
        told = hints[q][words % size] if len(q) else np.zeros(0, bool)
        codes = np.union1d(near, words[told])
        x, k = np.divmod(codes, size)
        own = (following[x] < 0) | (following[x] == k)
        codes, x, k = codes[own], x[own], k[own]
        n = np.zeros(len(codes), np.int64)
        if len(words):
            there = np.minimum(np.searchsorted(words, codes), len(words) - 1)
            n = np.where(words[there] == codes, shared[there], 0)
        n = np.where(no_text[v][x] | no_text[q][k], 3, n)
        o, f, z = order[x], begins[k], ends[k]
        score = np.select([(o >= f) & (o <= z), (o >= f - 4) & (o < f), (o > z) & (o <= z + 4)], [40, 25, 10], 0)
        score += 25 * hints[q][k] + 10 * (hints[q][k] & above[q][k] & (o < f) & (o > -FAR) & (f < FAR)) + np.minimum(15, 5 * n) + np.maximum(0, 20 - 3 * np.minimum(abs(o - f), abs(o - z)))
        yield x, np.ones(len(x), np.int64), q[k], np.where(following[x] >= 0, np.maximum(82, score), score)
        pairs = [j.pairs(begin, end) for j in (of_order, on_page)]
        x, k = np.divmod(np.unique(np.concatenate([x * max(1, len(m)) + k for x, k in pairs])), max(1, len(m)))
        own = following[x] < 0
        x, k = x[own], m[k[own]]
        inside = (order[x] >= first[k]) & (order[x] <= last[k] + 12)
        shared_page = paged[v][x] & paged[k] & (page[v][x] >= page[k]) & (page[v][x] <= page_end[k])
        score = 45 * inside + 20 * shared_page + 20 * (low[k] < FAR) + 10 * hints[v][x]
        some = inside | shared_page
        yield x[some], np.zeros(some.sum(), np.int64), k[some], score[some]

    target, kind, points = np.full(len(v), -1), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    total = np.cumsum(sum(j.counts() for j in (by_order, by_word, of_order, on_page)))
    done = 0
    while done < len(v):
        end = max(done + 1, int(np.searchsorted(total, MOST + (total[done - 1] if done else 0), "right")))
        x, of, to, score = (np.concatenate(c) for c in zip(*scored(done, end), strict=True))
        done = end
        x, of, to, score = (c[score > 0] for c in (x, of, to, score))
        best = np.lexsort((ids[to], of, -score, x))
        x, of, to, score = (c[best] for c in (x, of, to, score))
        top = np.flatnonzero(np.diff(x, prepend=-1) != 0)
        second = np.minimum(top + 1, max(0, len(x) - 1))
        other = (second > top) & (x[second] == x[top]) & (of[second] != of[top]) & (abs(score[second] - score[top]) < 10)
        asks, has = np.where(of[top] == 1, to[top], to[second]), np.where(of[top] == 1, to[second], to[top])
        index = low[asks]
        wins = other & (of[top] == 1) & (index < FAR) & (low[has] < FAR) & (index >= low[has]) & (index <= high[has])
        enough = score[top] >= 45
        pick = np.where(wins, second, top)[enough]
        at = x[top][enough]
        target[at], kind[at], points[at] = to[pick], of[pick], score[pick]
    none = target < 0
    taken = lambda rows: t.column("id").combine_chunks().take(pa.array(rows, pa.int64(), mask=rows < 0))
    kinds = pa.array(["material", "question"]).take(pa.array(kind, mask=none))
    follows = np.where(following >= 0, q[following], -1) if len(q) else following
    columns = [t.column("doc").take(pa.array(v)), taken(v), taken(follows), taken(target), kinds, pa.array(points, pa.int32(), mask=none)]
    return pa.Table.from_arrays(columns, names=["doc", "visual", "following", "target", "kind", "score"])


def _linked(rows: DataFrame) -> DataFrame:
    flat = _flat(rows)
    longs = [StructField(c, LongType()) for c in ("visual", "following", "target")]
    out = StructType([flat.schema["doc"], *longs]).add("kind", "string").add(StructField("score", IntegerType()))
    return _in_groups(flat, ["doc"], [], _assigned, out)


def following_question(visuals: DataFrame, questions: DataFrame, bottoms: DataFrame) -> DataFrame:
    """``visuals`` with following: the first question after it on its page, if that begins
    within 8 elements; where none is after it, the first of the next page, if the visual is
    below all that questions have on its page (``bottoms``: doc, page, bottom)."""
    found = _linked(elements(visuals, questions, None, bottoms)).select("doc", "visual", "following")
    return visuals.join(found, ["doc", "visual"], "left").select(*visuals.columns, "following")


def assigned(visuals: DataFrame, questions: DataFrame, materials: DataFrame, bottoms: DataFrame) -> DataFrame:
    """doc, visual, target, kind, score, confidence and warning of each visual.

    visuals: doc, visual, page, order, y0, context; questions: doc, question, index, page (of
    its mark), first, last, stem; materials: doc, material, first, last, page_start, page_end,
    low, high (the questions it is for, or null).  visual, question and material number a
    document's own.  The question that follows a visual has it for 82 points at least; else
    the best target counts, of equals a material, then the first.  If the second is of the
    other kind and less than 10 behind, a material that is for that question wins."""
    return assigned_elements(elements(visuals, questions, materials, bottoms))


def assigned_elements(rows: DataFrame) -> DataFrame:
    """What ``assigned`` returns, of doc and structs visual, question, material and bottom, of
    which any may be null: so one pass over a table can give them all."""
    out = _linked(rows).drop("following")
    warning = F.when(F.col("score").isNull(), F.lit("visual_unassigned")).when(F.col("score") < 65, F.lit("visual_assignment_low_confidence"))
    return out.withColumns({"confidence": F.when(F.col("score").isNotNull(), F.round(F.least(F.lit(1.0), F.col("score") / 100), 2)), "warning": warning})


def backward_links(questions: DataFrame, materials: DataFrame) -> DataFrame:
    """page, index and material of questions that a material further down is for as well.

    questions: page, index, y0, y1 and material, that which each has; materials: page, place,
    material and y0.  In order of place a material that some question at or below it has takes
    the last question, by y0 and index, that ends above it and that has none yet.  A page's
    questions and materials, which are few, are folded in one expression."""
    of_page = lambda df, name, *c: df.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    both = of_page(questions, "_q", "y0", "index", "y1", "material").join(of_page(materials, "_m", "place", "material", "y0"), "page")
    index, own = questions.schema["index"].dataType.simpleString(), materials.schema["material"].dataType.simpleString()

    def step(links: Column, m: Column) -> Column:
        wanted = F.exists("_q", lambda q: (q["material"] == m["material"]) & (q["y0"] >= m["y0"]))
        free = F.filter("_q", lambda q: (q["y1"] <= m["y0"]) & q["material"].isNull() & ~F.exists(links, lambda x: x["index"] == q["index"]))
        link = F.struct(F.get(F.transform(free, lambda q: q["index"]), F.size(free) - 1).alias("index"), m["material"].alias("material"))
        return F.when(F.coalesce(wanted, F.lit(False)) & (F.size(free) > 0), F.concat(links, F.array(link))).otherwise(links)

    links = F.aggregate("_m", F.array().cast(f"array<struct<index: {index}, material: {own}>>"), step)
    return both.select("page", F.inline(links))
