"""Golden cases, a file a brand and a question a part, against layouts made of the same parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import golden as O
from gradeloom.plans.registry import query
from gradeloom.sources import golden_cases as G
from gradeloom.sources import tables as T

CASE = """concat('  q', p_partkey, ':\\n    index: ', p_partkey, CASE WHEN p_size % 3 = 0 THEN '\\n    expected_visuals: []' ELSE concat('\\n    expected_visuals: [v', p_partkey, ']  # one') END,
    CASE p_size % 4 WHEN 0 THEN concat('\\n    expected_content_texts: ["', substring(p_name, 1, 3), '"]') WHEN 1 THEN '\\n\\n    expected_content_texts: [absent, p]' ELSE '' END,
    CASE WHEN p_size % 5 = 0 THEN concat('\\n    must_not_overlap_visuals: [v', p_partkey, ', gone]') ELSE '' END,
    CASE WHEN p_size % 9 = 0 THEN concat('\\n    must_not_overlap_questions: [q', p_partkey, ', 3]') ELSE '' END, '\\n')"""


@query(
    """WITH p AS (SELECT p_brand AS layout, 'q' || p_partkey AS question, p_partkey AS k, p_size AS s, p_name FROM part),
    t AS (SELECT * FROM p WHERE s % 7 <> 0),
    f AS (
        SELECT layout, question, 'missing_question' AS kind, CAST(k AS VARCHAR) AS detail FROM p WHERE s % 7 = 0
        UNION ALL SELECT layout, question, 'visual_ids_mismatch', if(s % 2 = 0, 'v' || k, '') FROM t WHERE (s % 3 = 0) = (s % 2 = 0)
        UNION ALL SELECT layout, question, 'content_text_missing', 'absent' FROM t WHERE s % 4 = 1 AND NOT contains(p_name, 'absent')
        UNION ALL SELECT layout, question, 'content_text_missing', 'p' FROM t WHERE s % 4 = 1 AND NOT contains(p_name, 'p')
        UNION ALL SELECT layout, question, 'source_bbox_missing', '' FROM t WHERE s % 6 = 0
        UNION ALL SELECT layout, question, 'source_overlaps_visual', 'v' || k FROM t WHERE s % 6 <> 0 AND s % 10 = 0
        UNION ALL SELECT layout, question, 'source_overlaps_question', CAST(k AS VARCHAR) FROM t WHERE s % 6 <> 0 AND s % 9 = 0
        UNION ALL SELECT layout, question, 'source_overlaps_banned_element', 'e' || k FROM t WHERE s % 6 <> 0 AND s % 8 = 0)
    SELECT * FROM f""",
    prelude=False,
)
def golden_failures(spark, sf_dir):
    parts = T.read(spark, sf_dir, "part")
    own = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.expr(CASE).alias("t"))))
    body = F.array_join(F.transform(own, lambda x: x["t"]), "")
    files = parts.groupBy("p_brand").agg(body.alias("_body")).select(F.concat("p_brand", F.lit(".yml")).alias("path"), F.concat(F.lit("# case\nname: '"), "p_brand", F.lit("'\npdf: a.pdf\npages: [1, 2]\n\nquestions:\n"), "_body").alias("text"))
    # a number sign begins a comment, so brands lose what follows it
    files = files.withColumn("text", F.regexp_replace("text", r"Brand#(\d+)", "Brand~$1"))
    expected = G.expected(G.sound(files)).withColumn("layout", F.regexp_replace("layout", "~", "#"))
    n, k = F.col("p_size"), F.col("p_partkey").cast("int")
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None)
    visual = F.concat(F.lit("v"), k.cast("string"))
    rows = parts.withColumn("layout", F.col("p_brand"))
    questions = rows.where(n % 7 != 0).select(
        "layout", k.alias("index"), F.lit(1).alias("place"), F.col("p_name").alias("content"), F.when(n % 2 == 0, F.array(visual)).alias("visual_ids"), none.cast("array<string>").alias("image_refs"),
        F.when(n % 6 != 0, box(0, 0, 10, 10)).alias("source_bbox"), k.alias("source_page"),
    )
    exercises = rows.select("layout", k.alias("index"), F.lit(1).alias("place"), F.array().cast("array<string>").alias("visual_ids"))
    texts = none.cast("array<struct<text: string, type: string>>")
    visuals = rows.select("layout", visual.alias("id"), F.when(n % 10 == 0, box(5, 5, 15, 15)).otherwise(box(50, 50, 60, 60)).alias("bbox"), none.cast("array<double>").alias("raw_bbox"), none.cast("array<double>").alias("expanded_bbox"), none.cast("array<string>").alias("child_visual_ids"), none.cast("string").alias("group_id"), texts.alias("absorbed"))
    elements = rows.select("layout", k.alias("page"), F.concat(F.lit("e"), k.cast("string")).alias("id"), F.when(n % 8 == 0, F.lit("heading")).otherwise(F.lit("text")).alias("type"), box(0, 0, 4, 4).alias("bbox"), F.lit("words").alias("text"))
    return O.failures(expected, O.overlaid(questions, exercises), visuals, elements)
