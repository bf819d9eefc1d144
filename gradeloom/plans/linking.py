"""Queries over visuals, questions and materials, made of lines of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import linking as L
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

STEM = "concat('w', l_partkey % 7, ' 词', l_suppkey % 5, ' w', l_partkey % 11, CASE l_partkey % 4 WHEN 0 THEN ' 上图' WHEN 1 THEN ' 下表' ELSE ' 计算' END)"
CONTEXT = "concat('w', l_partkey % 5, ' 词', l_suppkey % 6, CASE WHEN l_partkey % 9 = 0 THEN ' 统计' ELSE ' 无关' END)"


@query(
    f"""WITH l AS (
        SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS doc, row_number() OVER (PARTITION BY floor(l_orderkey / 12) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
               l_partkey % 400 AS place, *
        FROM lineitem),
    v AS (SELECT doc, id AS visual, place, CAST(floor(place / 40) AS INTEGER) AS page, place % 40 * 20.0 AS y0, {CONTEXT} AS context FROM l WHERE id % 3 = 0),
    q AS (SELECT doc, id AS question, CAST(l_quantity AS INTEGER) AS idx, CAST(floor(place / 40) AS INTEGER) AS page, place AS first, place + l_linenumber AS last, {STEM} AS stem FROM l WHERE id % 3 = 1),
    m AS (SELECT doc, id AS material, place AS first, place + 3 AS last, CAST(floor(place / 40) AS INTEGER) AS page_start, CAST(floor(place / 40) AS INTEGER) + l_linenumber % 2 AS page_end,
            if(l_returnflag = 'R', NULL, l_linenumber) AS low, if(l_returnflag = 'R', NULL, l_linenumber + 30) AS high FROM l WHERE id % 3 = 2),
    qv AS (
        SELECT v.doc, visual, question, idx, v.place, first, last, v.page AS vpage, q.page AS qpage, y0,
               CASE WHEN place BETWEEN first AND last THEN 40 WHEN place >= first - 4 AND place < first THEN 25 WHEN place > last AND place <= last + 4 THEN 10 ELSE 0 END
               + CASE WHEN stem LIKE '%图%' OR stem LIKE '%表%' THEN 25 ELSE 0 END + CASE WHEN stem LIKE '%上图%' AND place < first THEN 10 ELSE 0 END
               + least(15, 5 * len(list_filter(list_intersect(string_split(stem, ' '), string_split(context, ' ')), lambda w: length(w) >= 2)))
               + greatest(0, 20 - 3 * least(abs(place - first), abs(place - last))) AS score
        FROM v JOIN q ON q.doc = v.doc),
    same AS (SELECT doc, visual, min(first) AS f, min_by(question, (first, question)) AS question, any_value(place) AS place FROM qv WHERE qpage = vpage AND first > place GROUP BY 1, 2),
    low AS (SELECT doc, page, max(last % 40 * 20.0 + 10) AS bottom FROM q GROUP BY 1, 2),
    nxt AS (SELECT doc, page - 1 AS page, min_by(question, (first, question)) AS question FROM q GROUP BY 1, 2),
    fol AS (
        SELECT v.doc, v.visual, CASE WHEN same.f IS NOT NULL THEN if(same.f - v.place <= 8, same.question, NULL) WHEN v.y0 > bottom + 4 THEN nxt.question END AS question
        FROM v LEFT JOIN same ON same.doc = v.doc AND same.visual = v.visual LEFT JOIN low ON low.doc = v.doc AND low.page = v.page LEFT JOIN nxt ON nxt.doc = v.doc AND nxt.page = v.page),
    mv AS (
        SELECT v.doc, visual, material, low, high,
               CASE WHEN place BETWEEN first AND last + 12 THEN 45 ELSE 0 END + CASE WHEN page BETWEEN page_start AND page_end THEN 20 ELSE 0 END
               + CASE WHEN low IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN context LIKE '%统计%' THEN 10 ELSE 0 END AS score
        FROM v JOIN m ON m.doc = v.doc),
    c AS (
        SELECT doc, visual, question AS target, 'question' AS kind, score, idx, NULL AS low, NULL AS high FROM qv WHERE score > 0
        UNION ALL SELECT doc, visual, material, 'material', score, NULL, low, high FROM mv WHERE score > 0),
    o AS (SELECT *, row_number() OVER w AS n, lead(target) OVER w AS t2, lead(kind) OVER w AS k2, lead(score) OVER w AS s2, lead(idx) OVER w AS i2, lead(low) OVER w AS l2, lead(high) OVER w AS h2
        FROM c WINDOW w AS (PARTITION BY doc, visual ORDER BY score DESC, kind, target)),
    p AS (SELECT *, coalesce(k2 <> kind AND abs(score - s2) < 10 AND kind = 'question' AND idx BETWEEN l2 AND h2, false) AS swap FROM o WHERE n = 1 AND score >= 45),
    r AS (
        SELECT fol.doc, fol.visual, coalesce(fol.question, if(swap, t2, target)) AS target, if(fol.question IS NOT NULL, 'question', if(swap, 'material', kind)) AS kind,
               if(fol.question IS NOT NULL, greatest(82, g.score), if(swap, s2, p.score)) AS score
        FROM fol LEFT JOIN p ON p.doc = fol.doc AND p.visual = fol.visual LEFT JOIN qv g ON g.doc = fol.doc AND g.visual = fol.visual AND g.question = fol.question)
    SELECT doc, visual, target, kind, CAST(score AS BIGINT) AS score, CASE WHEN score IS NOT NULL THEN round(least(1.0, score / 100.0), 2) END AS confidence,
           CASE WHEN score IS NULL THEN 'visual_unassigned' WHEN score < 65 THEN 'visual_assignment_low_confidence' END AS warning FROM r""",
    prelude=False,
)
def linked_visuals(spark, sf_dir):
    doc = F.floor(F.col("l_orderkey") / 12)
    number = F.row_number().over(Window.partitionBy(doc).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = T.read(spark, sf_dir, "lineitem").withColumns({"doc": doc, "id": number.cast("long"), "order": F.col("l_partkey") % 400})
    rows = rows.withColumns({"page": F.floor(F.col("order") / 40).cast("int"), "kind": F.col("id") % 3})
    order, page, of = F.col("order"), F.col("page"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    last = order + F.col("l_linenumber")
    own = lambda kind, *c: F.when(F.col("kind") == kind, F.struct(*c))
    visual = own(0, F.col("id").alias("visual"), "order", "page", (order % 40 * 20.0).alias("y0"), F.expr(CONTEXT).alias("context"))
    question = own(1, F.col("id").alias("question"), F.col("l_quantity").cast("int").alias("index"), "page", order.alias("first"), last.alias("last"), F.expr(STEM).alias("stem"))
    bottom = own(1, "page", (last % 40 * 20.0 + 10).alias("bottom"))
    material = own(2, F.col("id").alias("material"), order.alias("first"), (order + 3).alias("last"), page.alias("page_start"), (page + F.col("l_linenumber") % 2).alias("page_end"), of.alias("low"), (of + 30).alias("high"))
    rows = rows.select("doc", visual.alias("visual"), question.alias("question"), material.alias("material"), bottom.alias("bottom"))
    return L.assigned_elements(rows).withColumn("score", F.col("score").cast("long"))


@query(
    """WITH RECURSIVE l AS (
        SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS page, row_number() OVER (PARTITION BY floor(l_orderkey / 5) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
               l_partkey % 100 * 10.0 AS y0, l_linenumber AS h, l_suppkey AS s FROM lineitem),
    q AS (SELECT page, id AS idx, y0, y0 + h * 5 AS y1, if(s % 2 = 0, NULL, s % 6) AS material FROM l WHERE id % 4 <> 0),
    m AS (SELECT page, min(id) AS place, s % 6 AS material, min_by(y0, id) AS y0 FROM l WHERE id % 4 = 0 GROUP BY page, s % 6),
    k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY place) AS n FROM m),
    g AS (SELECT page, list({'y0': y0, 'idx': idx, 'y1': y1, 'material': material} ORDER BY y0, idx) AS qs FROM q GROUP BY 1),
    r AS (
        SELECT page, 0::BIGINT AS n, qs, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS material FROM g
        UNION ALL
        SELECT page, n, qs, if(hit IS NULL, taken, list_append(taken, hit)), hit, material
        FROM (
            SELECT r.page, k.n, qs, taken, k.material,
                   if(len(list_filter(qs, lambda q: q.material = k.material AND q.y0 >= k.y0)) > 0,
                      list_filter(qs, lambda q: q.y1 <= k.y0 AND q.material IS NULL AND NOT list_contains(taken, q.idx))[-1].idx, NULL) AS hit
            FROM r JOIN k ON k.page = r.page AND k.n = r.n + 1))
    SELECT page, idx AS index, material FROM r WHERE idx IS NOT NULL""",
    prelude=False,
)
def backward_links(spark, sf_dir):
    page = F.floor(F.col("l_orderkey") / 5)
    number = F.row_number().over(Window.partitionBy(page).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    rows = T.read(spark, sf_dir, "lineitem").withColumns({"page": page, "id": number, "y0": F.col("l_partkey") % 100 * 10.0, "of": F.col("l_suppkey") % 6})
    questions = rows.where("id % 4 <> 0").select("page", F.col("id").alias("index"), "y0", (F.col("y0") + F.col("l_linenumber") * 5).alias("y1"), F.when(F.col("l_suppkey") % 2 != 0, F.col("of")).alias("material"))
    materials = rows.where("id % 4 = 0").groupBy("page", F.col("of").alias("material")).agg(F.min("id").alias("place"), F.min_by("y0", "id").alias("y0"))
    return L.backward_links(questions, materials)
