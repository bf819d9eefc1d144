"""Matching and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import review as R
from gradeloom.operators import scoring as S
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

TOKENS = """, d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[A-Da-d]\\s*[.]', ' ', 'g')), '[a-z0-9]{2,}')) AS t FROM documents),
    dt AS (SELECT doc_id, unnest(t) AS w FROM d), n AS (SELECT doc_id, count(*) AS size FROM dt WHERE w NOT IN ('image', 'chart', 'visuals') GROUP BY 1),
    b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[A-Da-d]\\s*[.]', ' ', 'g')), '[a-z0-9]{2,}'))) AS w FROM benchmark),
    o AS (SELECT doc_id, item_id, count(*) AS shared FROM dt JOIN b USING (w) WHERE w NOT IN ('image', 'chart', 'visuals') GROUP BY 1, 2)
"""


@query(TOKENS + """, e AS (SELECT o.doc_id, item_id, shared, CASE
        WHEN shared >= 10 AND shared / CAST(least(size, 30) AS DOUBLE) >= 0.35 THEN 35 WHEN shared >= 6 AND shared / CAST(least(size, 30) AS DOUBLE) >= 0.25 THEN 25
        WHEN shared >= 3 AND shared / CAST(least(size, 30) AS DOUBLE) >= 0.15 THEN 15 ELSE 0 END AS evidence FROM o JOIN n USING (doc_id))
    SELECT * FROM e WHERE evidence > 0""")
def token_overlap(spark, sf_dir):
    """Documents and benchmark items, all with all, that words tell to belong together."""
    q = T.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.significant_tokens(F.col("text")).alias("q"))
    s = T.read(spark, sf_dir, "benchmark").select("item_id", X.significant_tokens(F.col("text")).alias("s"))
    return S.evidence_pairs(q, s, ("doc_id", "q"), ("item_id", "s"))


def _match_inputs(spark, sf_dir):
    line = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 3 > 0).alias("same_index"), (F.col("l_suppkey") % 4 == 0).alias("section"), (F.col("l_suppkey") % 3 == 0).alias("anchor"), ((F.col("l_partkey") % 4).cast("int") * 10 + 5).alias("evidence"), (F.col("l_quantity") * 2).alias("confidence"), F.col("l_linenumber").alias("candidates"), (F.col("l_returnflag") == "R").alias("fallback"))
    score = S.match_score(F.col("same_index"), F.col("section"), F.col("anchor"), F.col("evidence"), F.col("confidence"), F.col("candidates"), F.col("fallback"))
    return line.withColumn("score", score)


MATCH = """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 3 > 0 AS si, l_suppkey % 4 = 0 AS se, l_suppkey % 3 = 0 AS an,
        (l_partkey % 4) * 10 + 5 AS ev, l_quantity * 2 AS co, l_linenumber AS n, l_returnflag = 'R' AS fb FROM lineitem),
    a AS (SELECT *, CASE WHEN si THEN 45 ELSE 0 END + CASE WHEN se THEN 10 ELSE 0 END + CASE WHEN an THEN 20 ELSE 0 END + ev + CASE WHEN co >= 85 THEN 5 ELSE 0 END + CASE WHEN n = 1 THEN 10 ELSE 0 END AS t FROM m),
    c AS (SELECT *, CASE WHEN n > 1 THEN least(t, 70) ELSE t END AS t2 FROM a),
    s AS (SELECT *, CAST(CASE WHEN fb THEN CASE WHEN si THEN 60 ELSE 0 END ELSE greatest(0, least(100, CASE WHEN ev < 20 AND NOT an THEN least(t2, 60) ELSE t2 END)) END AS INTEGER) AS score FROM c)
"""


@query(MATCH + "SELECT l_orderkey, l_linenumber, l_partkey, score FROM s", prelude=False)
def match_score(spark, sf_dir):
    return _match_inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query(MATCH + """SELECT CASE WHEN fb THEN 'ambiguous' WHEN n = 1 AND score >= 85 THEN 'matched' WHEN score >= 70 THEN 'ambiguous' ELSE 'unmatched' END AS status,
    count(*) AS n FROM s GROUP BY 1""", prelude=False)
def match_status(spark, sf_dir):
    rows = _match_inputs(spark, sf_dir).withColumn("status", S.match_status(F.col("score"), F.col("candidates"), F.col("fallback")))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, 4 + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END
    + CASE p_type WHEN 'ECONOMY' THEN 5 WHEN 'PROMO' THEN 2 ELSE 0 END + CASE WHEN p_size > 25 THEN 3 ELSE 0 END
    + CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END - p_partkey % 3 AS score FROM part""", prelude=False)
def completeness(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    audit = F.when(F.col("p_type") == "ECONOMY", F.lit("passed")).when(F.col("p_type") == "PROMO", F.lit("warning")).otherwise(F.lit("failed"))
    visual = F.when(n % 4 == 0, F.lit("success")).when(n % 4 == 1, F.lit("partial")).when(n % 4 == 2, F.lit("failed"))
    score = S.completeness(F.col("p_name"), [F.when(n % 2 == 0, F.lit("x")), F.when(n % 3 == 0, F.lit("y")), F.lit(" "), F.lit(None).cast("string")], audit, n > 25, visual, k % 2 == 0, k % 3)
    return T.read(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("""SELECT p_partkey, p_size % 5 <> 0 AND p_partkey % 3 = 0 AND (p_type = 'STANDARD' AND p_size % 2 = 0 OR p_type = 'ECONOMY' AND p_size % 7 <> 0) AS ok FROM part""", prelude=False)
def eligibility(spark, sf_dir):
    n = F.col("p_size")
    kind = F.when(F.col("p_type") == "ECONOMY", F.lit("passed")).when(F.col("p_type") == "STANDARD", F.lit("")).otherwise(F.lit("warning"))
    reviewed = (F.col("p_type") == "STANDARD") & (n % 2 == 1)
    error = F.when((F.col("p_type") == "ECONOMY") & (n % 7 == 0), F.lit("timeout"))
    return T.read(spark, sf_dir, "part").select("p_partkey", S.publishable(n % 5 == 0, F.col("p_partkey") % 3, kind, reviewed, error).alias("ok"))


@query("""WITH w AS (SELECT p_partkey, p_size, 0.5 + (p_size % 6) / 10.0 AS s0, p_size % 2 = 0 AS oi, p_size % 3 = 0 AS tm, p_size % 5 = 0 AS mq FROM part),
    c AS (SELECT *, least(s0, CASE WHEN mq THEN 0.4 ELSE 9 END, CASE WHEN oi THEN 0.6 ELSE 9 END, CASE WHEN tm THEN 0.7 ELSE 9 END, CASE WHEN p_size % 4 > 1 THEN 0.6 ELSE 9 END) AS s,
        CAST(oi AS INTEGER) + CAST(tm AS INTEGER) + CAST(mq AS INTEGER) AS n FROM w)
    SELECT p_partkey, CAST(least(greatest(round(s - least(0.2, 0.04 * n), 2), 0), 1) AS DOUBLE) AS confidence FROM c""", prelude=False)
def confidence_scores(spark, sf_dir):
    n = F.col("p_size")
    warnings = F.array_compact(F.array(F.when(n % 2 == 0, F.lit("options_incomplete")), F.when(n % 3 == 0, F.lit("teaching_text_mixed")), F.when(n % 5 == 0, F.lit("multiple_question_anchors"))))
    points = (F.lit(0.5).cast("decimal(4,2)") + (n % 6) / F.lit(10).cast("decimal(4,0)")).cast("double")
    return T.read(spark, sf_dir, "part").select("p_partkey", S.confidence(points, warnings, n % 4).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) < 4 THEN 'content_too_short' END AS reason,
    CASE WHEN p_size % 4 = 0 AND p_retailprice / 2000 >= 0.85 THEN 'applied' WHEN p_size % 4 = 0 AND p_retailprice / 2000 >= 0.65 THEN 'suggested' ELSE 'ignored' END AS correction,
    CASE WHEN p_size % 3 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0 OR p_size % 5 = 4 OR p_size % 17 = 1 THEN 'reasoner' ELSE 'fast' END AS model,
    CASE WHEN p_size % 2 = 0 THEN 'not_reviewable_missing_previous_page' WHEN p_size % 3 = 0 THEN 'not_reviewable_source_unverified'
        WHEN p_size % 5 = 0 THEN 'not_reviewable_missing_material_group' ELSE 'not_reviewable_missing_source_context' END AS review FROM part""", prelude=False)
def decisions(spark, sf_dir):
    n, c = F.col("p_size"), F.col("p_retailprice") / 2000
    return T.read(spark, sf_dir, "part").select(
        "p_partkey", S.rejected_because(F.col("p_name")).alias("reason"), S.correction(c, n % 4 == 0).alias("correction"),
        R.model_for(F.when(n % 3 == 0, 1), n % 7 == 0, n % 11 == 0, F.when(n % 13 == 0, 2), F.when(n % 5 == 4, 1), F.concat("p_name", F.when(n % 17 == 1, F.lit("看图表")).otherwise(F.lit("看图")))).alias("model"), S.review_decision(n % 2 == 0, n % 3 == 0, n % 5 == 0, F.lit(True)).alias("review"),
    )


@query("""WITH c AS (SELECT l_orderkey AS v, l_linenumber, l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 'material' ELSE 'question' END AS kind,
        CAST(l_quantity * 2 AS INTEGER) AS score, l_partkey % 2 = 0 AS covers FROM lineitem),
    r AS (SELECT *, row_number() OVER w AS n, lead(kind) OVER w AS k2, lead(score) OVER w AS s2, lead(target) OVER w AS t2, lead(covers) OVER w AS c2
        FROM c WINDOW w AS (PARTITION BY v ORDER BY score DESC, kind, target, covers)),
    p AS (SELECT *, k2 IS NOT NULL AND k2 <> kind AND abs(score - s2) < 10 AND CASE WHEN kind = 'material' THEN covers ELSE c2 END AS swap FROM r WHERE n = 1 AND score >= 45)
    SELECT v, CASE WHEN swap AND kind <> 'material' THEN t2 ELSE target END AS target, CASE WHEN swap THEN 'material' ELSE kind END AS kind,
    CASE WHEN swap AND kind <> 'material' THEN s2 ELSE score END AS score FROM p""", prelude=False)
def visual_targets(spark, sf_dir):
    c = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") == "R", F.lit("material")).otherwise(F.lit("question")).alias("kind"), (F.col("l_quantity") * 2).cast("int").alias("score"), (F.col("l_partkey") % 2 == 0).alias("covers"))
    return S.best_targets(c, "v").select("v", "target", "kind", "score")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, 20 - least(abs(l_linenumber - 2), abs(l_linenumber - 4)) * 3)
    + CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN 40 WHEN l_linenumber < 2 THEN 25 WHEN l_linenumber <= 8 THEN 10 ELSE 0 END + least(15, (l_suppkey % 5) * 5) AS question_score,
    CASE WHEN l_linenumber BETWEEN 3 AND 17 THEN 45 ELSE 0 END + CASE WHEN l_suppkey % 9 BETWEEN 2 AND 6 THEN 20 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END AS material_score
    FROM lineitem""", prelude=False)
def visual_scores(spark, sf_dir):
    k = F.col("l_linenumber")
    question = S.visual_question_score(k, F.lit(2), F.lit(4), F.lit("stem"), F.col("l_suppkey") % 5)
    material = S.visual_material_score(k, F.lit(3), F.lit(5), F.col("l_suppkey") % 9, F.lit(2), F.lit(6), F.col("l_returnflag") == "R", F.lit(""))
    return T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", question.alias("question_score"), material.alias("material_score"))
