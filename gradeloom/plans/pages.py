"""Queries over page elements: lines of documents with their places."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.functions import text as X
from gradeloom.functions.marks import question_marks as question_marks_
from gradeloom.operators import arrivals as A
from gradeloom.operators import documents as D
from gradeloom.operators import joins as J
from gradeloom.operators import regions as V
from gradeloom.operators import sequential as Q
from gradeloom.operators import windows as W
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

MARK, HEAD = "length(line) % 3 = 0", "length(line) % 7 = 0"


def _lines(spark, sf_dir):
    return T.page_lines(spark, sf_dir)


@query("SELECT page, line_no, line, y0 FROM lin")
def page_elements(spark, sf_dir):
    return _lines(spark, sf_dir).select("page", "line_no", "line", "y0")


@query("SELECT page, CAST(max(y0 + 10) AS DOUBLE) AS height FROM lin GROUP BY 1")
def page_heights(spark, sf_dir):
    return D.page_heights(_lines(spark, sf_dir)).withColumn("height", F.col("height").cast("double"))


@query(""", h AS (SELECT page, max(y0 + 10) AS height FROM lin GROUP BY 1)
    SELECT regexp_replace(line, '\\s+', '', 'g') AS text, count(DISTINCT lin.page) AS pages FROM lin JOIN h ON h.page = lin.page
    WHERE (y0 <= height * 0.08 OR y0 + 10 >= height * 0.94) AND length(line) <= 80 GROUP BY 1 HAVING count(DISTINCT lin.page) > 3""")
def header_footer_repeats(spark, sf_dir):
    return D.repeated_bands(_lines(spark, sf_dir))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(text, '[A-D]\. ')) AS BIGINT) AS options,
    CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS sentences FROM documents""", prelude=False)
def doc_type_features(spark, sf_dir):
    return D.features(T.read(spark, sf_dir, "documents", "doc_id", "text"), {"numbers": r"[0-9]+", "options": r"[A-D]\. ", "sentences": "[.!?]"})


@query("SELECT source, CASE WHEN sum(length(text)) < greatest(80, count(*) * 2000) THEN 'scanned' ELSE 'text' END AS kind FROM documents GROUP BY 1", prelude=False)
def pdf_kind(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    return d.select("source", D.kind_of(F.col("chars"), F.col("n") * 200).alias("kind"))


@query(""", w AS (SELECT CASE WHEN length(line) < 8 THEN 'content_too_short' END AS a, CASE WHEN length(line) > 200 THEN 'too_long' END AS b,
        CASE WHEN line LIKE '%  %' THEN 'noise' END AS c FROM lin)
    SELECT warning, count(*) AS n FROM (SELECT a AS warning FROM w UNION ALL SELECT b FROM w UNION ALL SELECT c FROM w) WHERE warning IS NOT NULL GROUP BY 1""")
def warning_histogram(spark, sf_dir):
    n = F.length("line")
    rows = _lines(spark, sf_dir).select(F.array_compact(F.array(F.when(n < 8, F.lit("content_too_short")), F.when(n > 200, F.lit("too_long")), F.when(F.contains("line", F.lit("  ")), F.lit("noise")))).alias("warnings"))
    return D.warning_histogram(rows, "warnings")


@query("SELECT line, count(*) AS n FROM lin GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark, sf_dir):
    return D.repeated_values(_lines(spark, sf_dir), "line")


@query(f"SELECT page, 0 AS x0, min(y0) AS y0, 1000 AS x1, max(y0) + 10 AS y1 FROM lin WHERE {MARK} GROUP BY 1")
def bbox_union(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(MARK).select("page", G.box(0, F.col("y0"), 1000, F.col("y0") + 10).alias("box"))
    out = rows.groupBy("page").agg(G.union_agg(F.col("box")).alias("b"))
    return out.select("page", *[F.col("b")[i].cast("int").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""SELECT page, line_no, sum(CASE WHEN {MARK} THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS segment FROM lin""")
def line_segments(spark, sf_dir):
    return W.segments(_lines(spark, sf_dir), ["page"], "line_no", F.expr(MARK)).select("page", "line_no", "segment")


@query(f""", s AS (SELECT *, sum(CASE WHEN {MARK} THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS segment FROM lin)
    SELECT page, segment, min(line_no) AS first, max(line_no) AS last, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM s WHERE segment > 0 AND NOT ({HEAD}) GROUP BY 1, 2""")
def core_blocks(spark, sf_dir):
    return W.blocks(_lines(spark, sf_dir), ["page"], "line_no", F.expr(MARK), F.expr(HEAD), "line")


@query(f"""SELECT page, line_no, max(CASE WHEN {HEAD} THEN line_no END) OVER (PARTITION BY page ORDER BY line_no) AS section FROM lin""")
def carry_forward_section(spark, sf_dir):
    return W.carried(_lines(spark, sf_dir), ["page"], "line_no", F.when(F.expr(HEAD), F.col("line_no")), "section").select("page", "line_no", "section")


@query("""SELECT page, line_no, coalesce(string_agg(CAST(length(line) AS VARCHAR), ' ') OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(CAST(length(line) AS VARCHAR), ' ') OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM lin""")
def neighbour_context(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("n", F.length("line").cast("string"))
    return W.context(rows, ["page"], "line_no", "n", 3, 3).select("page", "line_no", "before", "after")


@query("""SELECT page, line_no, CAST(sum(length(line)) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_chars FROM lin""")
def rolling_context(spark, sf_dir):
    out = W.recent(_lines(spark, sf_dir), ["page"], "line_no", "line", 10)
    return out.select("page", "line_no", F.aggregate("recent", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("recent_chars"))


@query(f""", e AS (SELECT *, min(CASE WHEN {MARK} THEN line_no END) OVER w AS m, min(CASE WHEN {HEAD} AND NOT ({MARK}) THEN line_no END) OVER w AS s FROM lin
        WINDOW w AS (PARTITION BY page ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT page, line_no FROM e WHERE m IS NOT NULL AND (s IS NULL OR m < s) AND NOT ({MARK}) AND NOT ({HEAD})""")
def prefaces(spark, sf_dir):
    return W.preface(_lines(spark, sf_dir), ["page"], "line_no", F.expr(MARK), F.expr(HEAD)).select("page", "line_no")


@query("""SELECT page, line_no, coalesce(length(line) >= lag(length(line)) OVER (PARTITION BY page ORDER BY line_no), true) AS rises FROM lin""")
def monotonic_indexes(spark, sf_dir):
    return W.rises(_lines(spark, sf_dir).withColumn("n", F.length("line")), ["page"], "line_no", "n").select("page", "line_no", "rises")


@query(f"""SELECT page, line_no, lead(y0) OVER (PARTITION BY page ORDER BY line_no) AS boundary FROM lin WHERE {MARK}""")
def next_boundary(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(MARK)
    return W.neighbours(rows, ["page"], ["line_no"], "y0").select("page", "line_no", F.col("next").alias("boundary"))


ROLES = [("option", r"^[A-D][.] "), ("question", r"[0-9]{3}"), ("caption", "^[A-Z][a-z]{0,4} "), ("heading", "^.{0,30}$")]


@query(r"""SELECT page, line_no, CASE WHEN regexp_matches(line, '^[A-D][.] ') THEN 'option' WHEN regexp_matches(line, '[0-9]{3}') THEN 'question'
    WHEN regexp_matches(line, '^[A-Z][a-z]{0,4} ') THEN 'caption' WHEN regexp_matches(line, '^.{0,30}$') THEN 'heading' ELSE 'text' END AS role FROM lin""")
def line_roles(spark, sf_dir):
    return _lines(spark, sf_dir).select("page", "line_no", X.role_of(F.col("line"), ROLES).alias("role"))


@query(f""", q AS (SELECT page, line_no, y0, y0 + 10 + 24 AS y1 FROM lin WHERE {MARK}), r AS (SELECT page, line_no AS region, y0 FROM lin WHERE {HEAD})
    SELECT q.page, q.line_no, r.region FROM q JOIN r ON r.page = q.page AND r.y0 BETWEEN q.y0 AND q.y1""")
def spatial_containment(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    q = lines.where(MARK).select("page", "line_no", G.box(0, F.col("y0"), 1000, F.col("y0") + 34).alias("box"))
    r = lines.where(HEAD).select("page", F.col("line_no").alias("region"), G.box(0, F.col("y0"), 1000, F.col("y0") + 10).alias("box"))
    return V.box_join(q, r, ["page"], G.contains_y, axes=(1,)).select("a.page", "a.line_no", "b.region")


@query(f""", v AS (SELECT page, line_no, y0, y0 + 10 AS y1 FROM lin WHERE {HEAD}), o AS (SELECT page, y0, y0 + 10 AS y1 FROM lin WHERE {MARK} AND NOT ({HEAD}))
    SELECT page, line_no FROM v WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page = v.page AND greatest(o.y0 - v.y1, v.y0 - o.y1, 0) <= 80)""")
def duplicate_visuals(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("box", G.box(0, F.col("y0"), 1000, F.col("y0") + 10))
    others = lines.where(f"{MARK} AND NOT ({HEAD})").select("page", "box")
    return J.without_duplicates_of(lines.where(HEAD).select("page", "line_no", "box"), others, ["page"]).select("page", "line_no")


@query(f""", a AS (SELECT page, line_no, y0, y0 + 5 + length(line) % 40 AS y1 FROM lin WHERE {MARK})
    SELECT a.page, a.line_no AS l, b.line_no AS r, round((least(a.y1, b.y1) - greatest(a.y0, b.y0)) / CAST(least(a.y1 - a.y0, b.y1 - b.y0) AS DOUBLE), 4) AS overlap
    FROM a JOIN a b ON a.page = b.page AND a.line_no < b.line_no AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def overlap_pairs(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(MARK).select("page", "line_no", G.box(0, F.col("y0"), 1000, F.col("y0") + 5 + F.length("line") % 40).alias("box"))
    out = V.box_join(rows, rows, ["page"], G.intersects).where("a.line_no < b.line_no")
    return out.select("a.page", F.col("a.line_no").alias("l"), F.col("b.line_no").alias("r"), F.round(G.overlap_ratio(F.col("a.box"), F.col("b.box")), 4).alias("overlap"))


@query(f""", p AS (SELECT page, line_no, CAST(y0 AS DOUBLE) AS y0, CAST(y0 + 10 AS DOUBLE) AS y1 FROM lin WHERE {MARK}),
    i AS (SELECT *, sum(CASE WHEN y0 > r + 20 OR r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS island
        FROM (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM p))
    SELECT page, CAST(island - 1 AS INTEGER) AS part, 0.0 AS x0, min(y0) AS y0, 1000.0 AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS n FROM i GROUP BY 1, 2""")
def merged_visuals(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    rows = _lines(spark, sf_dir).where(MARK).select("page", F.lit(0.0).alias("x0"), d("y0").alias("y0"), F.lit(1000.0).alias("x1"), (d("y0") + 10).alias("y1"))
    return Q.merged_boxes(rows, ["page"], 20.0)


@query(""", a AS (SELECT DISTINCT page, line_no * 2 + length(line) % 5 AS place FROM lin),
    k(page, place) AS (SELECT page, min(place) FROM a GROUP BY 1 UNION ALL SELECT k.page, min(a.place) FROM k JOIN a ON a.page = k.page AND a.place >= k.place + 3 GROUP BY k.page, k.place)
    SELECT page, CAST(place AS INTEGER) AS at FROM k""")
def kept_anchors(spark, sf_dir):
    """Anchors a few characters after the last one kept go; each depends on those before."""
    rows = _lines(spark, sf_dir).select("page", (F.col("line_no") * 2 + F.length("line") % 5).alias("at"))
    return Q.kept_anchors(rows, ["page"], "at")


#: Names of chapters that lines are given, by their number; other lines are none.
CHAPTERS = """CASE line_no % 9 WHEN 0 THEN concat('第', line_no % 90, '章 ') WHEN 2 THEN '三、' WHEN 3 THEN concat(line_no % 90, '.x') WHEN 5 THEN '考法二 '
    WHEN 7 THEN concat(line_no % 90, '. ') ELSE '文 ' END"""


@query(f""", t AS (SELECT page, line_no, concat({CHAPTERS}, if(line_no % 27 = 0, repeat('长', 60), ''), substring(line, 1, 12)) AS title FROM lin),
    v AS (SELECT *, CASE WHEN line_no % 27 = 0 THEN NULL WHEN line_no % 9 = 0 THEN 0 WHEN line_no % 9 = 2 THEN 1 WHEN line_no % 9 = 3 THEN 2 WHEN line_no % 9 = 5 THEN 3
        WHEN line_no % 9 = 7 AND length(title) <= 8 THEN 2 END AS level FROM t),
    r(page, line_no, path) AS (
        SELECT page, line_no, if(level IS NULL, [], [title]) FROM v WHERE line_no = 0
        UNION ALL SELECT v.page, v.line_no, CASE WHEN level IS NULL THEN path ELSE list_append(path[1:level], title) END FROM r JOIN v ON v.page = r.page AND v.line_no = r.line_no + 1)
    SELECT page, line_no, array_to_string(path, '/') AS path FROM r""")
def chapter_paths(spark, sf_dir):
    title = F.concat(F.expr(CHAPTERS), F.when(F.col("line_no") % 27 == 0, F.lit("长" * 60)).otherwise(F.lit("")), F.substring("line", 1, 12))
    rows = _lines(spark, sf_dir).select("page", "line_no", title.alias("title"))
    rows = rows.withColumn("level", X.chapter_level(F.col("title")).cast("double"))
    return Q.chapter_paths(rows, ["page"], "line_no", "level", "title").select("page", "line_no", "path")


#: Numbers that lines are given, in all forms; some lines only look like a question.
NUMBERED = """concat(CASE line_no % 9 WHEN 0 THEN concat('【例 ', {n}, '】 ') WHEN 1 THEN concat('例题', {n}, '、') WHEN 2 THEN concat('第 ', {n}, ' 题：') WHEN 3 THEN concat({n}, '. ')
    WHEN 4 THEN concat({n}, '、') WHEN 5 THEN concat({n}, ' 根据') WHEN 6 THEN concat({n}, '') WHEN 7 THEN '12. 方法' ELSE '文 ' END,
    CASE WHEN line_no % 9 = 6 THEN '' WHEN line_no % 18 = 4 THEN concat(substring(line, 1, 20), ' .... 7') ELSE line END)""".format(n="line_no % 9000 + 100")
CONTENTS = r"'^.{1,80}(\.{4,}|…{2,})\s*[0-9]+\s*$'"


@query(f""", t AS (SELECT page, line_no, {NUMBERED} AS line FROM lin),
    s AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY page ORDER BY line_no) - length(line) - 1 AS BIGINT) AS start FROM t)
    SELECT page, count(*) AS n, CAST(sum(line_no % 9000 + 100) AS BIGINT) AS indexes, CAST(sum(start) AS BIGINT) AS starts
    FROM s WHERE line_no % 9 < 7 AND NOT regexp_matches(line, {CONTENTS}) GROUP BY 1""")
def question_marks(spark, sf_dir):
    """Marks of whole texts whose lines are numbered in all forms."""
    text = _numbered(spark, sf_dir, NUMBERED)
    out = text.select("page", F.explode(question_marks_(F.col("text"))).alias("m"))
    return out.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("m.index").alias("indexes"), F.sum(F.col("m.start").cast("long")).alias("starts"))


def _numbered(spark, sf_dir, form):
    rows = _lines(spark, sf_dir).select("page", "line_no", F.expr(form).alias("line"))
    own = A.full_texts(rows, "page", "line_no", "line")
    return own.select("page", F.concat("text", F.lit("\n")).alias("text"))


ANCHORED = """concat(CASE line_no % 7 WHEN 0 THEN concat('【例 ', {n}, '】') WHEN 1 THEN concat('例', {n}, '：') WHEN 2 THEN concat('第 ', {n}, ' 题') WHEN 3 THEN concat({n}, '. ')
    WHEN 5 THEN concat(' ', {n}, '、') ELSE '文 ' END, line)""".format(n="line_no % 9000")


@query(f"""SELECT page, max(line_no) AS last FROM lin WHERE {HEAD} GROUP BY 1""")
def answer_page(spark, sf_dir):
    """The last line of a page's that has a keyword."""
    return _lines(spark, sf_dir).where(HEAD).groupBy("page").agg(F.max("line_no").alias("last"))


@query("""SELECT length(line) AS index, max_by(line, page * 10000 + line_no) AS text, count(DISTINCT page) AS pages FROM lin GROUP BY 1""")
def semantic_merge(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.length("line").alias("index"), (F.col("page") * 10000 + F.col("line_no")).alias("o"), F.col("line").alias("text"), "page")
    out = D.merged_versions(rows, "index", "o", ["text"], "page")
    return out.select("index", "text", F.size("pages").cast("long").alias("pages"))


@query(f"""SELECT page, count(*) AS total, count(*) FILTER ({MARK}) AS addable, count(*) FILTER ({HEAD}) AS manual, count(*) FILTER (line LIKE '%.') AS ended FROM lin GROUP BY 1""")
def candidate_summary(spark, sf_dir):
    return D.summary(_lines(spark, sf_dir), ["page"], {"addable": F.expr(MARK), "manual": F.expr(HEAD), "ended": F.col("line").like("%.")})


@query(f""", r AS (SELECT page, line_no, 100.0 AS x0, y0 - 20 AS y0, 600.0 AS x1, y0 + 40 AS y1 FROM lin WHERE {MARK}),
    w AS (SELECT page, y0, y0 + 10 AS y1, 0.0 AS x0, length(line) * 5.0 AS x1 FROM lin)
    SELECT r.page, line_no, sum(coalesce((w.x1 - w.x0) * (w.y1 - w.y0), 0)) / 30000.0 AS coverage, count(w.page) AS words
    FROM r LEFT JOIN w ON w.page = r.page AND least(w.x1, r.x1) > greatest(w.x0, r.x0) AND least(w.y1, r.y1) > greatest(w.y0, r.y0) GROUP BY 1, 2""")
def text_coverage(spark, sf_dir):
    """How much of a rectangle around each marked line words take, which may be more than all."""
    lines = _lines(spark, sf_dir)
    rects = lines.where(MARK).select("page", "line_no", G.box(100, F.col("y0") - 20, 600, F.col("y0") + 40).alias("box"))
    words = lines.select("page", F.col("line").alias("text"), G.box(0, F.col("y0"), F.length("line") * 5, F.col("y0") + 10).alias("box"))
    return V.text_in(rects, words, ["page"]).select("page", "line_no", "coverage", "words")


@query(f""", t AS (SELECT page, line_no, {ANCHORED} AS line, line_no % 7 IN (0, 1, 2, 3, 5) AS anchor FROM lin),
    g AS (SELECT *, sum(CAST(anchor AS INTEGER)) OVER (PARTITION BY page ORDER BY line_no) AS part FROM t),
    b AS (SELECT page, part, any_value(line_no % 9000) FILTER (anchor) AS index, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10)) AS block FROM g WHERE part > 0 GROUP BY 1, 2)
    SELECT page, CAST(part - 1 AS INTEGER) AS part, CAST(index AS INTEGER) AS index, md5(block) AS digest FROM b""")
def text_at_anchors(spark, sf_dir):
    """Whole texts cut at their anchors, each part up to the next."""
    text = _numbered(spark, sf_dir, ANCHORED)
    return text.select("page", F.posexplode(X.cut_at_anchors(F.col("text"))).alias("part", "p")).select("page", "part", "p.index", F.md5("p.block").alias("digest"))
