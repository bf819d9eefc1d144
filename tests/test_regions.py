"""Boxes on a grid against all pairs, components against a flood fill, regions by hand."""

from __future__ import annotations

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.operators import joins as J
from gradeloom.operators import regions as V

BOX = "page int, k int, box array<double>"


def boxes(rng, n):
    out = []
    for k in range(n):
        x, y, w, h = rng.randrange(-50, 400), rng.randrange(-50, 400), rng.choice([0, 1, 30, 300]), rng.choice([0, 2, 40, 200])
        out.append((rng.randrange(3), k, [float(v) for v in (x, y, x + w, y + h)]))
    return out + [(0, -1, None), (1, -2, [5.0, 5.0]), (0, -3, [9.0, 9.0, 1.0, 1.0])]


def touch(a, b, mx=0, my=0):
    ok = all(x is not None and len(x) == 4 and x[2] >= x[0] and x[3] >= x[1] for x in (a, b))
    return ok and min(a[2] + mx, b[2]) >= max(a[0] - mx, b[0]) and min(a[3] + my, b[3]) >= max(a[1] - my, b[1])


@pytest.mark.parametrize("cell", [16.0, 128.0, 1000.0])
def test_box_join(spark, cell):
    rng = random.Random(cell)
    left, right = boxes(rng, 60), boxes(rng, 60)
    a, b = spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)
    near = lambda x, y: (G.y_gap(x, y) <= 30) & (F.least(x[2], y[2]) >= F.greatest(x[0], y[0]))
    got = V.box_join(a, b, ["page"], near, margin=(0.0, 30.0), cell=cell).select("a.k", F.col("b.k").alias("j"))
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and touch(x[2], y[2], 0, 30))
    assert sorted(map(tuple, got.collect())) == want  # each pair once
    hit = {k for k, _ in want}
    alone = V.box_join(a, b, ["page"], near, "left_anti", margin=(0.0, 30.0), cell=cell)
    assert sorted(r.k for r in alone.collect()) == sorted(x[1] for x in left if x[1] not in hit)


def test_no_pairs_of_a_page_without_buckets(spark):
    a = spark.createDataFrame(boxes(random.Random(1), 5), BOX)
    plan = J.without_duplicates_of(a, a, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_b0" in plan and "_b1" in plan and "Cartesian" not in plan


def flood(cells):
    left, of, n = set(cells), {}, 0
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        stack = [start]
        while stack:
            c = stack.pop()
            if c in left:
                left.remove(c)
                of[c] = n
                stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        n += 1
    return of


def test_components(spark):
    rng = random.Random(2)
    snake = [(x, y) for y in range(9) for x in range(9) if y % 2 == 0 or x == (8 if y % 4 == 1 else 0)]
    pages = {1: snake, 2: [(rng.randrange(12), rng.randrange(12)) for _ in range(70)], 3: [(0, 0)], 4: [(-1, 5), (0, 5), (2, 5)]}
    rows = [(p, x, y) for p, cells in pages.items() for x, y in cells + cells[:3]]
    got = V.connected_cells(spark.createDataFrame(rows, "page int, x int, y int"), ["page"]).collect()
    assert {(r.page, r.x, r.y): r.component for r in got} == {(p, x, y): c for p, cells in pages.items() for (x, y), c in flood(set(cells)).items()}
    assert V.connected_cells(spark.createDataFrame([], "page int, x int, y int"), ["page"]).count() == 0


def test_tables_and_images(spark):
    lines = [(1, "line", None, 100.0, 10.0 * k, 0.0, 10.0 * k) for k in range(6)]
    short = [(2, "line", None, 0.0, 10.0 * k, 100.0, 10.0 * k) for k in range(5)] + [(2, "rect", None, 0.0, 0.0, 19.0, 9.0)]
    flat = [(3, "line", None, 0.0, 9.0 * k, 100.0, 9.0 * k) for k in range(6)]
    paths = [(4, "path", "s", 0.0, 0.0, 200.0, 100.0)] * 6 + [(5, "path", "clip", 0.0, 0.0, 200.0, 100.0)] * 9 + [(5, "path", "s", 0.0, 0.0, 200.0, 0.0)] * 9
    drawings = spark.createDataFrame(lines + short + flat + paths, "page int, form string, kind string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, tuple(r.box)) for r in V.tables_of(drawings).collect()} == {(1, (0.0, 0.0, 100.0, 50.0)), (4, (0.0, 0.0, 200.0, 100.0))}
    images = spark.createDataFrame([(1, [100.0, 0.0, 120.0, 50.0]), (4, [199.0, 99.0, 250.0, 150.0]), (4, [0.0, 0.0, 5.0, 50.0])], "page int, box array<double>")
    got = {(r.page, r.type) for r in V.visual_elements(images, drawings).collect()}
    assert got == {(1, "image"), (1, "table"), (4, "image")}  # page 1's image only touches its table


def test_dark_regions(spark):
    block = lambda page, x0, y0: [(page, x0 + i, y0 + j, 0.09) for i in range(7) for j in range(4)]
    cells = block(1, 0, 0) + block(1, 0, 10) + block(2, 0, 0) + block(3, 0, 0) + block(4, 0, 0) + [(5, i, 0, 0.9) for i in range(40)] + [(6, i, j, 0.08) for i in range(9) for j in range(9)]
    for n in range(6):
        cells += block(7, 0, 10 * n)
    words = [(2, "第 3 题", [0.0, 0.0, 9.0, 9.0])] + [(3, "w", [k * 5.0, 0.0, k * 5.0 + 2, 2.0]) for k in range(19)]
    got = V.dark_regions(
        spark.createDataFrame(cells, "page int, x int, y int, dark double"),
        spark.createDataFrame([(1, [0.0, 0.0, 112.0, 17.0]), (4, [0.0, 0.0, 112.0, 16.0])], "page int, box array<double>"),
        spark.createDataFrame(words, "page int, text string, box array<double>"),
    )
    assert sorted((r.page, r.n, r.box[1]) for r in got.collect()) == [(1, 1, 160.0), (4, 1, 0.0), (7, 1, 0.0), (7, 2, 160.0), (7, 3, 320.0), (7, 4, 480.0)]


def near(a, b):
    band = max(1, max(a[2], b[2]) - min(a[0], b[0]))
    return max(a[0], b[0]) - min(a[2], b[2]) <= 36 or max(1, a[2] - a[0]) / band >= 0.55 or max(1, b[2] - b[0]) / band >= 0.55


def climbed(box, captions, walls):
    top, taken = box[1], set()
    while True:
        above = {
            k: c for k, c in captions.items()
            if k not in taken and c[3] <= top + 1 and top - c[3] <= 28 and near(box, c)
            and not any(w[1] >= min(c[3], top) - 0.5 and w[3] <= max(c[3], top) + 0.5 for w in walls)
        }
        if not above:
            return taken
        low = max(c[3] for c in above.values())
        row = {k for k, c in above.items() if abs(c[3] - low) <= 2 or min(c[3], low + 2) - max(c[1], low - 2) > 0}
        taken |= row
        top = min(top, *(captions[k][1] for k in row))


def test_absorbed_captions(spark):
    rng = random.Random(5)
    flip = lambda b: [b[0], -b[3], b[2], -b[1]]
    seeds, texts, want = [], [], set()
    for page in range(6):
        own = {k: [float(v) for v in (x, y, x + 30, y + h)] for k, (x, y, h) in enumerate((rng.randrange(300), rng.randrange(300), rng.choice([0, 9, 20])) for _ in range(40))}
        kinds = {k: rng.choice(["caption"] * 6 + ["option", "text"]) for k in own}
        words = {k: rng.choice(["words"] * 9 + ["第 3 题 x", " B、y"]) for k in own}
        asks = {k for k in own if kinds[k] == "option" or words[k] != "words"}
        captions, walls = {k: b for k, b in own.items() if kinds[k] == "caption" and k not in asks}, [own[k] for k in asks]
        texts += [(page, k, kinds[k], words[k], b) for k, b in own.items()] + [(page, 99, "caption", "no box", None)]
        for n in range(5):
            x, y = rng.randrange(300), rng.randrange(300)
            box = [float(v) for v in (x, y, x + 40, y + 30)]
            seeds.append((page, n, box))
            found = climbed(box, captions, walls) | climbed(flip(box), {k: flip(b) for k, b in captions.items()}, [flip(w) for w in walls])
            want |= {(page, n, k) for k in found}
    s = spark.createDataFrame(seeds, "page int, id int, box array<double>")
    t = spark.createDataFrame(texts, "page int, text_id int, type string, text string, box array<double>")
    got = {(r.page, r.id, r.text_id) for r in V.absorbed_captions(s, t, ["page"]).collect()}
    assert got == want and len(want) > 20
    assert V.absorbed_captions(s, t.limit(0), ["page"]).count() == 0


def test_captions_of_many_pages(spark):
    # more rows than are looked at together, and one shuffle for all rounds
    pages = spark.range(9000).select(F.col("id").alias("page"))
    box = lambda x, y, w, h: F.array(*[(F.lit(float(v)) + F.col("page") % 3) for v in (x, y, x + w, y + h)])
    s = pages.select("page", F.lit(1).alias("id"), box(0, 100, 60, 40).alias("box"))
    texts = [(1, "caption", 80), (2, "caption", 62), (3, "caption", 10), (4, "option", 160), (5, "caption", 175), (6, "text", 90), *((k, "text", 500) for k in range(7, 10))]
    t = reduce(DataFrame.unionByName, [pages.select("page", F.lit(k).alias("text_id"), F.lit(kind).alias("type"), F.lit("words").alias("text"), box(0, y, 90, 9).alias("box")) for k, kind, y in texts])
    out = V.absorbed_captions(s, t, ["page"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    got = out.groupBy("text_id").count().collect()
    assert {(r["text_id"], r["count"]) for r in got} == {(1, 9000), (2, 9000)}


def test_components_across_bands(spark):
    rng = random.Random(4)
    snake = [(x, y) for y in range(13) for x in range(9) if y % 2 == 0 or x == (8 if y % 4 == 1 else 0)]
    pages = {1: snake, 2: [(rng.randrange(12), rng.randrange(-9, 12)) for _ in range(150)], 3: [(0, 3), (0, 4)], 4: [(0, 0)]}
    df = spark.createDataFrame([(p, x, y) for p, cells in pages.items() for x, y in cells], "page int, x int, y int")
    want = {(p, x, y): c for p, cells in pages.items() for (x, y), c in flood(set(cells)).items()}
    for band in (1, 4, 1024):
        assert {(r.page, r.x, r.y): r.component for r in V.connected_cells(df, ["page"], band).collect()} == want


def test_tables_meet_images_once(spark):
    lines = spark.range(600).select((F.col("id") / 6).cast("int").alias("page"), F.lit("line").alias("form"), F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("x0"), (F.col("id") % 6 * 300.0).alias("y0"), F.lit(2000.0).alias("x1"), (F.col("id") % 6 * 300.0).alias("y1"))
    images = spark.range(0, 100, 2).select(F.col("id").cast("int").alias("page"), G.box(10, 10, 1900, 20).alias("box"))
    out = V.visual_elements(images, lines)
    # neither side is dealt to the buckets of a grid
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page, r.type) for r in out.collect()} == {(k, "table" if k % 2 else "image") for k in range(100)}


def test_dark_cells_are_not_ranked(spark):
    """Cells become regions before anything is sorted, and regions are worked out once."""
    cells = spark.createDataFrame([(1, x, y, 0.5) for x in range(9) for y in range(5)], "page int, x int, y int, dark double")
    boxes = spark.createDataFrame([], "page int, text string, box array<double>")
    got = V.dark_regions(cells, boxes, boxes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "dark" not in plan
    assert [r.n for r in got.collect()] == [1]
