"""Queries over boxes and grids, made of the lines of orders: eight or more orders are a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.operators import regions as V
from gradeloom.operators import sequential as Q
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

DRAWN = """WITH l AS (SELECT CAST(floor(l_orderkey / 2) AS BIGINT) AS page, *, (l_partkey % 50) * 10.0 AS x, (l_suppkey % 60) * 12.0 AS y FROM lineitem),
    img AS (SELECT page, x AS x0, y AS y0, x + l_quantity AS x1, y + l_linenumber * 4 AS y1 FROM l WHERE l_returnflag = 'R' AND l_partkey % 3 = 0),
    seen AS (SELECT * FROM img WHERE x1 - x0 > 5 AND y1 - y0 > 5),
    drawn AS (
        SELECT page, x AS x0, y AS y0, x + l_quantity AS x1, y + l_linenumber * 4 AS y1 FROM l WHERE l_linenumber % 3 = 1 AND l_linestatus = 'F'
        UNION ALL SELECT page, x - l_quantity, y, x, y FROM l WHERE l_linenumber % 3 = 2
        UNION ALL SELECT page, x, y, x + 9, y + l_quantity FROM l WHERE l_linenumber % 3 = 0),
    dense AS (SELECT * FROM drawn WHERE x1 - x0 >= 20 OR y1 - y0 >= 20 OR (x1 - x0) * (y1 - y0) >= 200),
    tab AS (
        SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM dense GROUP BY 1
        HAVING count(*) >= 6 AND max(x1) - min(x0) >= 100 AND max(y1) - min(y0) >= 50)
"""


def _lines(spark, sf_dir):
    page = F.floor(F.col("l_orderkey") / 2)
    return T.read(spark, sf_dir, "lineitem").withColumns({"page": page, "x": F.col("l_partkey") % 50 * 10.0, "y": F.col("l_suppkey") % 60 * 12.0, "w": F.col("l_quantity"), "h": F.col("l_linenumber") * 4})


def _flat(rows):
    return rows.select(*[c for c in rows.columns if c != "box"], *[F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    DRAWN
    + """SELECT page, 'image' AS type, x0, y0, x1, y1 FROM seen UNION ALL
    SELECT page, 'table', x0, y0, x1, y1 FROM tab WHERE NOT EXISTS (
        SELECT 1 FROM seen s WHERE s.page = tab.page AND least(s.x1, tab.x1) > greatest(s.x0, tab.x0) AND least(s.y1, tab.y1) > greatest(s.y0, tab.y0))""",
    prelude=False,
)
def visual_elements(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in "xywh")
    images = rows.where("l_returnflag = 'R' AND l_partkey % 3 = 0").select("page", G.box(x, y, x + w, y + h).alias("box"))
    turn = F.col("l_linenumber") % 3
    form = F.when(turn == 1, F.lit("path")).when(turn == 2, F.lit("line")).otherwise(F.lit("rect"))
    # lines are drawn from right to left
    x1 = F.when(turn == 1, x + w).when(turn == 2, x - w).otherwise(x + 9)
    y1 = F.when(turn == 1, y + h).when(turn == 2, y).otherwise(y + w)
    kind = F.when(F.col("l_linestatus") == "F", F.lit("fs")).otherwise(F.lit("clip"))
    drawings = rows.select("page", form.alias("form"), kind.alias("kind"), x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return _flat(V.visual_elements(images, drawings))


CELLS = """WITH RECURSIVE l AS (SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS page, l_partkey % 16 AS x, l_suppkey % 16 AS y, l_partkey % 40 * 6.0 AS wx, l_suppkey % 37 * 6.0 AS wy, * FROM lineitem),
    c AS (SELECT DISTINCT page, x, y, y * 16 + x AS cell FROM l WHERE l_discount > 0.01),
    r(page, x, y, first) AS (
        SELECT page, x, y, cell FROM c
        UNION
        SELECT c.page, c.x, c.y, r.first FROM r JOIN c ON c.page = r.page AND abs(c.x - r.x) + abs(c.y - r.y) = 1 WHERE r.first < c.cell),
    n AS (SELECT page, x, y, min(first) AS first FROM r GROUP BY ALL),
    k AS (SELECT page, x, y, CAST(dense_rank() OVER (PARTITION BY page ORDER BY first) - 1 AS INTEGER) AS component FROM n)
"""


def _cells(spark, sf_dir):
    page = F.floor(F.col("l_orderkey") / 40)
    return T.read(spark, sf_dir, "lineitem").withColumns({"page": page, "x": F.col("l_partkey") % 16, "y": F.col("l_suppkey") % 16})


@query(CELLS + "SELECT page, x, y, component FROM k", prelude=False)
def connected_cells(spark, sf_dir):
    return V.connected_cells(_cells(spark, sf_dir).where("l_discount > 0.01"), ["page"])


@query(
    CELLS
    + """, b AS (SELECT page, component, min(x) * 16.0 AS x0, min(y) * 16.0 AS y0, (max(x) + 1) * 16.0 AS x1, (max(y) + 1) * 16.0 AS y1 FROM k GROUP BY 1, 2),
    big AS (SELECT * FROM b WHERE x1 - x0 >= 100 AND y1 - y0 >= 50),
    e AS (SELECT page, wx AS x0, wy AS y0, wx + 60 + l_quantity AS x1, wy + 40 + l_quantity AS y1 FROM l WHERE l_partkey % 61 = 0),
    w AS (SELECT page, wx AS x0, wy AS y0, wx + 30 AS x1, wy + 8 AS y1, if(l_partkey % 199 = 0, 'A. yes', 'word') AS text FROM l WHERE l_linenumber = 1),
    t AS (
        SELECT big.page, component, sum((w.x1 - w.x0) * (w.y1 - w.y0)) AS covered, count(*) AS words, bool_or(regexp_matches(text, '[A-D][.．、]')) AS asks
        FROM big JOIN w ON w.page = big.page AND least(w.x1, big.x1) > greatest(w.x0, big.x0) AND least(w.y1, big.y1) > greatest(w.y0, big.y0) GROUP BY ALL),
    ok AS (
        SELECT big.*, row_number() OVER (PARTITION BY big.page ORDER BY big.component) AS n FROM big LEFT JOIN t ON t.page = big.page AND t.component = big.component
        WHERE coalesce(covered, 0) / ((x1 - x0) * (y1 - y0)) <= 0.25 AND coalesce(words, 0) <= 18 AND NOT coalesce(asks, false)
          AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = big.page AND greatest(0, least(e.x1, big.x1) - greatest(e.x0, big.x0)) * greatest(0, least(e.y1, big.y1) - greatest(e.y0, big.y0)) / ((big.x1 - big.x0) * (big.y1 - big.y0)) > 0.25))
    SELECT page, CAST(n AS INTEGER) AS n, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM ok WHERE n <= 4""",
    prelude=False,
)
def dark_regions(spark, sf_dir):
    rows = _cells(spark, sf_dir).withColumns({"wx": F.col("l_partkey") % 40 * 6.0, "wy": F.col("l_suppkey") % 37 * 6.0})
    cells = rows.select("page", "x", "y", F.when(F.col("l_discount") > 0.01, F.lit(0.5)).otherwise(F.lit(0.08)).alias("dark"))
    x, y, q = F.col("wx"), F.col("wy"), F.col("l_quantity")
    existing = rows.where("l_partkey % 61 = 0").select("page", G.box(x, y, x + 60 + q, y + 40 + q).alias("box"))
    text = F.when(F.col("l_partkey") % 199 == 0, F.lit("A. yes")).otherwise(F.lit("word"))
    words = rows.where("l_linenumber = 1").select("page", text.alias("text"), G.box(x, y, x + 30, y + 8).alias("box"))
    return _flat(V.dark_regions(cells, existing, words))


@query(
    """WITH RECURSIVE l AS (
        SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page, l_partkey % 50 * 10.0 AS x0, l_suppkey % 60 * 12.0 AS y0, l_quantity AS w, l_linenumber * 4 AS h FROM lineitem),
    b AS (SELECT page, x0, y0, x0 + w AS x1, y0 + h AS y1, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x0 + w, y0 + h) AS k FROM l),
    r AS (
        SELECT page, k, 0 AS cluster, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS cs FROM b WHERE k = 1
        UNION ALL
        SELECT page, k, hit - 1 AS cluster,
               list_concat(cs[1:hit - 1], [{'x0': least(x0, coalesce(cs[hit].x0, x0)), 'y0': least(y0, coalesce(cs[hit].y0, y0)), 'x1': greatest(x1, coalesce(cs[hit].x1, x1)), 'y1': greatest(y1, coalesce(cs[hit].y1, y1))}], cs[hit + 1:]) AS cs
        FROM (SELECT b.*, cs, coalesce(list_position(list_transform(cs, lambda c: b.x0 - 18 < c.x1 AND b.x1 + 18 > c.x0 AND b.y0 - 18 < c.y1 AND b.y1 + 18 > c.y0), true), len(cs) + 1) AS hit
              FROM r JOIN b ON b.page = r.page AND b.k = r.k + 1))
    SELECT page, CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM r GROUP BY 1, 2""",
    prelude=False,
)
def clustered_boxes(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("page", F.floor(F.col("l_orderkey") / 4)).select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return Q.clustered_boxes(rows, ["page"], 18.0).groupBy("page", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE l AS (
        SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS page, row_number() OVER (PARTITION BY floor(l_orderkey / 8) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
               l_partkey % 30 * 12.0 AS x, l_suppkey % 25 * 11.0 AS y
        FROM lineitem),
    t AS (SELECT page, id, x AS x0, y AS y0, x + 90 AS x1, y + 9 AS y1, id % 9 = 8 AS asks FROM l WHERE id % 3 <> 0),
    g AS (SELECT page, list({'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) FILTER (NOT asks) AS caps, coalesce(list({'y0': y0, 'y1': y1}) FILTER (asks), []) AS walls FROM t GROUP BY 1),
    s AS (
        SELECT l.page, l.id, x AS x0, x + 60 AS x1, d, if(d = 1, y, -(y + 40)) AS top,
               list_transform(list_filter(caps, lambda c: greatest(l.x, c.x0) - least(l.x + 60, c.x1) <= 36 OR 60 / greatest(1, greatest(l.x + 60, c.x1) - least(l.x, c.x0)) >= 0.55
                   OR 90 / greatest(1, greatest(l.x + 60, c.x1) - least(l.x, c.x0)) >= 0.55),
                   lambda c: {'id': c.id, 'y0': if(d = 1, c.y0, -c.y1), 'y1': if(d = 1, c.y1, -c.y0)}) AS caps,
               list_transform(walls, lambda w: {'y0': if(d = 1, w.y0, -w.y1), 'y1': if(d = 1, w.y1, -w.y0)}) AS walls
        FROM l JOIN g ON g.page = l.page, (VALUES (1), (2)) v(d) WHERE l.id % 3 = 0),
    r(page, id, d, top, caps, walls, row_, turn) AS (
        SELECT page, id, d, top, caps, walls, CAST([] AS BIGINT[]), 0 FROM s
        UNION ALL
        SELECT page, id, d, least(top, list_min(list_transform(hit, lambda c: c.y0))), list_filter(caps, lambda c: NOT list_contains(list_transform(hit, lambda h: h.id), c.id)), walls, list_transform(hit, lambda h: h.id), turn + 1
        FROM (
            SELECT *, list_filter(can, lambda c: abs(c.y1 - near) <= 2 OR least(c.y1, near + 2) > greatest(c.y0, near - 2)) AS hit
            FROM (
                SELECT *, list_max(list_transform(can, lambda c: c.y1)) AS near
                FROM (
                    SELECT *, list_filter(caps, lambda c: c.y1 <= top + 1 AND top - c.y1 <= 28 AND len(list_filter(walls, lambda w: w.y0 >= least(c.y1, top) - 0.5 AND w.y1 <= greatest(c.y1, top) + 0.5)) = 0) AS can
                    FROM r)))
        WHERE len(hit) > 0)
    SELECT page, id, count(DISTINCT text_id) AS n, CAST(sum(DISTINCT text_id) AS BIGINT) AS ids FROM (SELECT page, id, unnest(row_) AS text_id FROM r) GROUP BY 1, 2""",
    prelude=False,
)
def absorbed_captions(spark, sf_dir):
    """How many captions each visual takes in, and their numbers' sum."""
    page = F.floor(F.col("l_orderkey") / 8)
    number = F.row_number().over(Window.partitionBy(page).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    rows = T.read(spark, sf_dir, "lineitem").withColumns({"page": page, "id": number, "x": F.col("l_partkey") % 30 * 12.0, "y": F.col("l_suppkey") % 25 * 11.0})
    x, y = F.col("x"), F.col("y")
    seeds = rows.where("id % 3 = 0").select("page", "id", G.box(x, y, x + 60, y + 40).alias("box"))
    kind = F.when(F.col("id") % 9 == 8, F.lit("option")).otherwise(F.lit("caption"))
    texts = rows.where("id % 3 <> 0").select("page", F.col("id").alias("text_id"), kind.alias("type"), F.lit("words").alias("text"), G.box(x, y, x + 90, y + 9).alias("box"))
    found = V.absorbed_captions(seeds, texts, ["page"])
    return found.groupBy("page", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("text_id").alias("ids"))
