"""Visual regions of pages: boxes met through a grid, tables from lines, dark regions from cells.

Boxes are dealt to the buckets of a grid that they touch, and meet others of their group in a
bucket only.  A pair is looked at once, in the bucket of the first corner of what they share,
so nothing has to be made distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gradeloom.functions import geometry as G
from gradeloom.sources.shared import written


def _bucketed(boxes: DataFrame, cell: float, margin: tuple[float, float], axes: tuple[int, ...]) -> DataFrame:
    out = boxes.where(F.size("box") == 4)
    for k in axes:
        low, high = (F.floor((F.get("box", i) + m) / cell) for i, m in ((F.lit(k), -margin[k]), (F.lit(k + 2), margin[k])))
        out = out.withColumn(f"_b{k}", F.explode(F.when(low <= high, F.sequence(low, high))))
    return out


def box_join(left: DataFrame, right: DataFrame, on: list[str], condition: Callable[[Column, Column], Column], how: str = "inner", margin: tuple[float, float] = (0.0, 0.0), axes: tuple[int, ...] = (0, 1), cell: float = 128.0) -> DataFrame:
    """Boxes (column box) of the same group for which ``condition`` holds, as frames a and b; or,
    ``left_anti``, those of the left for which there is none.

    The condition may hold only for boxes that touch, on the named axes (0 x, 1 y), once the
    left one has a margin.  What isn't a box touches nothing."""
    if how == "left_anti":
        hit = box_join(left, right, on, condition, "inner", margin, axes, cell).select("a.*").distinct().alias("h")
        same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in left.columns])
        return left.alias("l").join(hit, same, "left_anti").select("l.*")
    a, b = _bucketed(left, cell, margin, axes).alias("a"), _bucketed(right, cell, (0.0, 0.0), axes).alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*on, *(f"_b{k}" for k in axes))]
    met += [F.floor(F.greatest(F.get("a.box", F.lit(k)) - margin[k], F.get("b.box", F.lit(k))) / cell) == F.col(f"a._b{k}") for k in axes]
    both = a.join(b, reduce(lambda x, y: x & y, [*met, condition(F.col("a.box"), F.col("b.box"))]))
    mine = lambda n, df: [F.col(f"{n}.{c}").alias(c) for c in df.columns]
    return both.select(F.struct(*mine("a", left)).alias("a"), F.struct(*mine("b", right)).alias("b"))


def upright(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box with these corners, whichever way a line was drawn."""
    return G.box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def tables_of(drawings: DataFrame, least: int = 6, width: float = 100.0, height: float = 50.0) -> DataFrame:
    """page and box of the table that a page's drawn lines make, if they do.

    drawings: page, form (``path``, a drawing's own box, or its parts ``line`` and ``rect``),
    kind (of a path: what is stroked or filled counts) and x0, y0, x1, y1.  A line is dense if
    it is 20 long on a side, or 200 in area."""
    corners = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    path = (F.col("form") == "path") & F.col("kind").isin("s", "f", "fs") & (corners[2] > corners[0]) & (corners[3] > corners[1])
    own = drawings.where(path | F.col("form").isin("line", "rect"))
    own = own.select("page", F.when(F.col("form") == "line", upright(*corners)).otherwise(G.box(*corners)).alias("box"))
    b = F.col("box")
    dense = own.where((b[2] - b[0] >= 20) | (b[3] - b[1] >= 20) | (G.area(b) >= 200))
    found = dense.groupBy("page").agg(F.count(F.lit(1)).alias("n"), G.union_agg(b).alias("box"))
    return found.where((F.col("n") >= least) & (b[2] - b[0] >= width) & (b[3] - b[1] >= height)).select("page", "box")


def visual_elements(images: DataFrame, drawings: DataFrame) -> DataFrame:
    """page, type and box of a page's images (page, box; specks of 5 and less go) and of its
    table, unless an image shares area with it."""
    b = F.col("box")
    seen = images.where((b[2] - b[0] > 5) & (b[3] - b[1] > 5)).select("page", "box")
    # a page has one table at most, so each image meets one
    at, box = (F.col("a.page") == F.col("b.page")), G.intersects(F.col("a.box"), F.col("b.box"))
    tables = tables_of(drawings).alias("a").join(seen.alias("b"), at & box, "left_anti")
    return seen.withColumn("type", F.lit("image")).unionByName(tables.withColumn("type", F.lit("table"))).select("page", "type", "box")


#: Rows that are looked at together.
CHUNK = 1 << 16


def _begins(t: pa.Table, on: list[str]) -> np.ndarray:
    """Whether a row is the first of its group, in sorted rows.  A null is like no other."""
    out = np.ones(t.num_rows, bool)
    same = [pc.fill_null(pc.equal(c.slice(1), c.slice(0, t.num_rows - 1)), False) for c in (t.column(g).combine_chunks() for g in on)]
    out[1:] = ~reduce(np.logical_and, [s.to_numpy(zero_copy_only=False) for s in same])
    return out


def _last_group(batches: list[pa.RecordBatch], on: list[str]) -> int:
    """Where the last batch's last group begins, in rows of all; 0 if there is no other before it."""
    t = pa.Table.from_batches(batches[-2:])
    at = int(np.flatnonzero(_begins(t, on))[-1])
    return at + sum(b.num_rows for b in batches[:-2]) if at else 0


def _in_groups(rows: DataFrame, on: list[str], order: list[str], met: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """What ``met`` makes of rows in batches of whole groups, sorted by group and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            waiting += b.num_rows
            if waiting < CHUNK or not (last := _last_group(kept, on)):
                continue
            t = pa.Table.from_batches(kept)
            yield from met(t.slice(0, last)).to_batches()
            kept = t.slice(last).to_batches()
            waiting = t.num_rows - last
        if kept:
            yield from met(pa.Table.from_batches(kept)).to_batches()

    return rows.repartition(*on).sortWithinPartitions(*on, *order).mapInArrow(run, schema)


#: Rows of a grid whose cells are joined together in one place.
BAND = 1024


def _labelled(cells: DataFrame, group: list[str], band: int = BAND) -> DataFrame:
    """Distinct cells with the first cell (run, by row) of their component within their band of
    rows: labels fall along rows and columns, and from label to label, until none falls."""
    own = [*group, "_band"]
    rows = cells.select(*group, F.floor(F.col("y") / band).alias("_band"), "y", "x").where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*group, "y", "x")]))
    first = [StructField("_y", rows.schema["y"].dataType), StructField("_x", rows.schema["x"].dataType)]
    out = StructType([*(rows.schema[c] for c in (*group, "y", "x")), *first])

    def met(t: pa.Table) -> pa.Table:
        g, y, x = np.cumsum(_begins(t, own)), t.column("y").to_numpy().astype(np.int64), t.column("x").to_numpy().astype(np.int64)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])
        rows_ = np.flatnonzero(new)
        g, y, x = g[rows_], y[rows_], x[rows_]
        by_column = np.lexsort((y, x, g))
        n = np.arange(len(g))
        beside = n[1:][(g[1:] == g[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1] + 1)]
        gc, yc, xc = g[by_column], y[by_column], x[by_column]
        below = np.flatnonzero((gc[1:] == gc[:-1]) & (xc[1:] == xc[:-1]) & (yc[1:] == yc[:-1] + 1))
        u, v = np.concatenate([beside - 1, by_column[below]]), np.concatenate([beside, by_column[below + 1]])
        label = n.copy()
        while len(u):
            a, b = label[u], label[v]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label = up
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
        mine, its = pa.array(rows_), pa.array(rows_[label])
        columns = [*(t.column(c).take(mine) for c in (*group, "y", "x")), t.column("y").take(its), t.column("x").take(its)]
        return pa.Table.from_arrays(columns, names=out.names)

    return _in_groups(rows, own, ["y", "x"], met, out).withColumn("run", F.struct(F.col("_y").alias("y"), F.col("_x").alias("x"))).drop("_y", "_x")


def _components(cells: DataFrame, group: list[str], band: int = BAND) -> DataFrame:
    """Distinct cells (x, y) of a group's grid with first, the first cell (y, x) of their
    component of 4 neighbours.

    Components of a band of rows are the nodes, cells above one another across bands their
    links, which grids of one band have none of.  In each round a node joins
    the neighbour that a hash of the round puts first, links move to what their ends joined, and
    repeats go, until none is left: all groups at once, a third or so of a chain's nodes a
    round.  Nothing is gathered but the number of links."""
    runs = written(_labelled(cells, group, band))
    at = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    last, next_ = runs.where(F.pmod(F.col("y") + 1, F.lit(band)) == 0).alias("a"), runs.where(F.pmod("y", F.lit(band)) == 0).alias("b")
    below = last.join(next_, reduce(lambda p, q: p & q, [*at, F.col("a.x") == F.col("b.x"), F.col("a.y") + 1 == F.col("b.y")]))
    pairs = below.select(*[F.col(f"a.{g}") for g in group], F.col("a.run").alias("u"), F.col("b.run").alias("v")).distinct()
    links = written(pairs.unionByName(pairs.select(*group, F.col("v").alias("u"), F.col("u").alias("v"))))
    if links.isEmpty():
        return runs.withColumnRenamed("run", "first")
    named = runs.select(*group, "run").distinct().withColumn("name", F.col("run"))
    turn = 0
    while links.count():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(f"{c}.y"), F.col(f"{c}.x")).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        to = written(links.groupBy(*group, "u").agg(F.min(drawn("v")).alias("m")).select(*group, "u", F.least(F.col("m"), drawn("u"))["id"].alias("to")))
        moved = lambda df, c: df.join(to.withColumnRenamed("u", c), [*group, c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        links = written(moved(moved(links, "u"), "v").where(F.col("u") != F.col("v")).select(*group, "u", "v").distinct())
        named = written(moved(named, "name"))
        turn += 1
    first = named.join(named.groupBy(*group, "name").agg(F.min("run").alias("first")), [*group, "name"])
    return runs.join(first.select(*group, "run", "first"), [*group, "run"]).drop("run")


def connected_cells(cells: DataFrame, group: list[str], band: int = BAND) -> DataFrame:
    """Distinct cells (x, y) of a group's grid with their component of 4 neighbours, from 0 in
    the order of first cells, by row."""
    place = F.dense_rank().over(Window.partitionBy(*group).orderBy("first")) - 1
    return _components(cells, group, band).withColumn("component", place).drop("first")


#: How near a caption is to what has absorbed so far, and texts that begin a question or an option.
STEP = 28.0
BEGINS = r"(?U)^\s*(?:(?:【\s*)?例\s*\d+|第\s*\d+\s*题|[A-D][.．、])"


def _climbed(starts: np.ndarray, groups: np.ndarray, boxes: np.ndarray, captions: np.ndarray, walls: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of captions that seeds (rows ``starts``) absorb above them, as pairs of seed and
    caption: a row of captions a round, all seeds at once, until no seed finds another.  Pairs
    of a group are made ``most`` at a time, or a seed's."""
    first, counts = np.searchsorted(groups[captions], groups[starts]), np.searchsorted(groups[captions], groups[starts], "right")
    counts -= first
    done = 0
    while done < len(starts):
        end = done + max(1, int(np.searchsorted(np.cumsum(counts[done:]), most, "right")))
        some, n = starts[done:end], counts[done:end]
        of = np.repeat(np.arange(len(some)), n)
        text = captions[np.repeat(first[done:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        done = end
        a, c = boxes[some[of]], boxes[text]
        both = np.maximum(np.maximum(a[:, 2], c[:, 2]) - np.minimum(a[:, 0], c[:, 0]), 1.0)
        wide = np.maximum(np.maximum(a[:, 2] - a[:, 0], c[:, 2] - c[:, 0]), 1.0)
        near = (np.minimum(a[:, 2], c[:, 2]) - np.maximum(a[:, 0], c[:, 0]) >= -36.0) | (wide / both >= 0.55)
        of, text = of[near], text[near]
        top = boxes[some, 1]
        while len(of):
            low = boxes[text, 3]
            # tops only rise, so what is below one stays below; the rest may be met later
            ahead = low <= top[of] + 1
            of, text, low = of[ahead], text[ahead], low[ahead]
            reach = np.flatnonzero(top[of] - low <= STEP)
            reach = reach[~_walled(np.minimum(low, top[of])[reach] - 0.5, np.maximum(low, top[of])[reach] + 0.5, groups[text[reach]], groups, boxes, walls)]
            nearest = np.full(len(some), -np.inf)
            np.maximum.at(nearest, of[reach], low[reach])
            at = nearest[of[reach]]
            taken = reach[(np.abs(low[reach] - at) <= 2) | ((np.minimum(low[reach], at + 2) - np.maximum(boxes[text[reach], 1], at - 2)) > 0)]
            if not len(taken):
                break
            yield some[of[taken]], text[taken]
            np.minimum.at(top, of[taken], boxes[text[taken], 1])
            # a seed that found nothing is done
            left = np.zeros(len(some), bool)
            left[of[taken]] = True
            rest = left[of]
            rest[taken] = False
            of, text = of[rest], text[rest]


def _walled(low: np.ndarray, high: np.ndarray, group: np.ndarray, groups: np.ndarray, boxes: np.ndarray, walls: np.ndarray) -> np.ndarray:
    """Whether a wall of the group lies between low and high: the lowest of those that end by
    high begins at low or later.  Walls are sorted by group and end."""
    out = np.zeros(len(low), bool)
    if not len(walls):
        return out
    # walls and ends in one order, a wall before an end that it just meets
    g, y = np.concatenate([groups[walls], group]), np.concatenate([boxes[walls, 3], high])
    order = np.lexsort((np.arange(len(g)) >= len(walls), y, g))
    begins = np.concatenate([boxes[walls, 1], np.full(len(low), -np.inf)])[order]
    parts = g[order]
    best = pd.Series(begins).groupby(parts).cummax().to_numpy()
    place = np.empty(len(g), np.int64)
    place[order] = np.arange(len(g))
    return best[place[len(walls) :]] >= low


def absorbed_captions(seeds: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """on, id and text_id of the captions that each seed (id, box; id is unique in a group) takes
    in, from the nearest row above and below on, as long as the next is within 28 of what it has,
    near it in x, and no question or option stands between.  texts: on, text_id (unique in a
    group), type, text, box.  What isn't a box of four numbers takes no part.

    One shuffle: a group's seeds and texts lie together and stream by in batches of whole groups."""
    asks = F.col("type").isin("question_marker", "option") | F.rlike(F.coalesce("text", F.lit("")), F.lit(BEGINS))
    part = F.when(F.coalesce(asks, F.lit(False)), 2).when(F.col("type") == "caption", 1)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    corners = F.transform("box", lambda v: v.cast("double"))
    rows = seeds.select(*on, F.lit(0).alias("_part"), "id", none(texts, "text_id"), corners.alias("box"))
    rows = rows.unionByName(texts.select(*on, part.alias("_part"), none(seeds, "id"), "text_id", corners.alias("box")))
    given = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in ("_part", *on)])
    rows = rows.where(given & (F.size("box") == 4) & F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = rows.select(*on, "_part", "id", "text_id", *[F.col("box")[i].alias(f"_{i}") for i in range(4)])
    out = StructType([*(rows.schema[c] for c in (*on, "id", "text_id"))])

    def met(t: pa.Table) -> pa.Table:
        groups = np.cumsum(_begins(t, on)) - 1
        boxes = np.stack([t.column(f"_{i}").to_numpy() for i in range(4)], axis=1)
        kind = t.column("_part").to_numpy()
        own, captions, walls = (np.flatnonzero(kind == k) for k in range(3))
        # what lies below lies above once the page is turned over
        pairs = [p for b in (boxes, boxes[:, [0, 3, 2, 1]] * [1, -1, 1, -1]) for p in _climbed(own, groups, b, captions, walls)]
        codes = np.unique(np.concatenate([s * len(kind) + c for s, c in pairs])) if pairs else np.empty(0, np.int64)
        seed, text = (pa.array(x) for x in np.divmod(codes, max(1, len(kind))))
        return pa.Table.from_arrays([*(t.column(c).take(seed) for c in (*on, "id")), t.column("text_id").take(text)], names=[*on, "id", "text_id"])

    return _in_groups(rows, on, ["_part"], met, out)


#: Fixed value: texts that are a question's.
QUESTION = r"(?:【\s*)?例\s*\d+|第\s*\d+\s*题|[A-D][.．、]|哪一年|年份是|超过|同比增量"


def text_in(rects: DataFrame, words: DataFrame, on: list[str], question: str = QUESTION) -> DataFrame:
    """Rectangles (unique rows, with box) with the words (box, text) that share area with them:
    coverage, the words' whole areas over the rectangle's, which is at least 1; words, their
    number; and asks, whether one of them reads like a question."""
    key = rects.columns
    met = box_join(rects, words.select(*on, "text", "box"), on, G.intersects)
    told = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in key]).agg(
        F.sum(G.area(F.col("b.box"))).alias("_area"), F.count(F.lit(1)).alias("_words"), F.bool_or(F.rlike("b.text", F.lit(question))).alias("_asks")
    )
    both = rects.alias("l").join(told.alias("t"), reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]), "left")
    share = F.coalesce("_area", F.lit(0.0)) / F.greatest(G.area(F.col("l.box")), F.lit(1.0))
    return both.select("l.*", share.alias("coverage"), F.coalesce("_words", F.lit(0)).alias("words"), F.coalesce("_asks", F.lit(False)).alias("asks"))


def dark_regions(cells: DataFrame, existing: DataFrame, words: DataFrame, cell: float = 24.0, scale: float = 1.5, most: int = 4, question: str = QUESTION) -> DataFrame:
    """page, n (from 1) and box of each dark region of a page that may be a drawing.

    cells: page, x, y, dark, the dark pixels' share of a cell; existing: page and box of what is
    known; words: page, text and box.  A region is a component of cells that are more than 8%
    dark; it is at least 100 x 50, no known box takes more than a quarter of it, words cover a
    quarter at most and are 18 at most, and none of them reads like a question.  A page has four
    at most, by first cell."""
    found = _components(cells.where(F.col("dark") > 0.08), ["page"])
    edge = lambda f, c, d: (f(c) + d) * cell / scale
    regions = found.groupBy("page", "first").agg(
        G.box(edge(F.min, "x", 0), edge(F.min, "y", 0), edge(F.max, "x", 1), edge(F.max, "y", 1)).alias("box")
    )
    b = F.col("box")
    # few are left, and three joins need them
    regions = written(regions.where((b[2] - b[0] >= 100) & (b[3] - b[1] >= 50)))
    share = lambda a, o: G.overlap(a, o) / F.greatest(G.area(a), F.lit(1.0))
    free = box_join(regions, existing.select("page", "box"), ["page"], lambda a, o: share(a, o) > 0.25, "left_anti")
    read = text_in(free.select("page", "first", "box"), words, ["page"], question)
    kept = read.where((F.col("coverage") <= 0.25) & (F.col("words") <= 18) & ~F.col("asks"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("first"))
    return kept.select("page", place.alias("n"), "box").where(F.col("n") <= most)
