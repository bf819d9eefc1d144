"""Reviews of a vision model merged into questions, made of parts: up to two a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import vision_review as V
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T


@query(
    """WITH q AS (
        SELECT p_brand AS layout, p_partkey AS k, p_size AS s, if(p_size % 4 = 0, ['v' || p_partkey], []) AS refs, if(p_size % 6 = 0, ['old'], []) AS old FROM part),
    r AS (
        SELECT *, 1 AS n FROM q WHERE s % 5 <> 0 AND s % 11 <> 0 UNION ALL SELECT *, 2 FROM q WHERE s % 7 = 0 AND s % 11 <> 0),
    a AS (
        SELECT *, CASE (s + n) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS answer, if(s % 9 = 0, NULL, (s % 9) / 10.0) AS conf, if(s % 13 = 0, 'no_figure', '') AS unknown,
               CASE (s + n) % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 3 THEN 'passed' WHEN 4 THEN 'skipped' ELSE 'warning' END AS status,
               s % 3 <> 0 AS can, if((s + n) % 4 = 1, ['f' || n], []) AS risk, if(s % 4 <> 2 AND n = 1, 's' || (s % 3), '') AS summary, s % 2 = 0 AS has_v, s % 10 = 0 AS has_w, k % 2 = 0 AS w_known,
               CASE s % 8 WHEN 0 THEN 'failed' WHEN 4 THEN 'partial' WHEN 6 THEN 'success' ELSE '' END AS vs
        FROM r),
    b AS (
        SELECT *, CASE WHEN NOT has_v THEN NULL
                   WHEN vs = 'failed' THEN if(has_w, 'partial', 'failed') WHEN vs = 'partial' THEN 'partial' WHEN vs = 'success' OR summary <> '' OR has_w THEN 'success' ELSE 'partial' END AS v_status
        FROM a),
    g AS (
        SELECT layout, k, count(*) AS corrections, max_by(status, n) AS audit_status, max_by(answer, n) FILTER (answer <> '') AS answer,
               max_by(can AND (answer <> '' OR unknown = ''), n) AS can_solve, max(coalesce(conf, 0)) AS c1, max(if(has_v, s / 100.0, 0)) AS c2,
               list_distinct(flatten(list(risk)) || coalesce(list(unknown) FILTER (unknown <> ''), [])) AS flags,
               bool_or(status <> 'passed' OR NOT (can AND (answer <> '' OR unknown = '')) OR len(risk) > 0 OR unknown <> '') AS doubt, max_by(v_status, n) FILTER (v_status IS NOT NULL) AS visual_status,
               bool_or(has_v) AS has_v, bool_or(has_w AND w_known) AS has_w, max_by(summary, n) FILTER (summary <> '' AND has_v) AS summary, count(*) FILTER (status = 'passed') AS applied,
               min_by(len(risk) > 0 OR unknown <> '', n) AS first_flags
        FROM b GROUP BY 1, 2)
    SELECT q.layout, q.k, coalesce(corrections, 0) AS corrections, coalesce(applied, 0) AS applied, audit_status, answer AS candidate_answer, can_solve, greatest(c1, c2) AS confidence,
           CAST(len(list_distinct(old || coalesce(flags, []))) AS INTEGER) AS n_flags, doubt IS NOT NULL AND (doubt OR len(old) > 0) AS needs_review, visual_status,
           CAST(CASE WHEN coalesce(has_v, false) THEN 1 ELSE len(refs) END + if(coalesce(has_w, false), 1, 0) AS INTEGER) AS n_images,
           if(coalesce(has_v, false), coalesce(g.summary, ''), NULL) AS image_summary
    FROM q LEFT JOIN g ON g.layout = q.layout AND g.k = q.k""",
    prelude=False,
)
def reviewed_questions(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    parts = T.read(spark, sf_dir, "part").withColumn("layout", F.col("p_brand"))
    ref = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    none = F.array().cast("array<string>")
    some = lambda c, v: F.when(c, F.array(v)).otherwise(none)
    images = F.when(s % 4 == 0, F.array(V.image(ref("v"), F.lit("stem")))).otherwise(F.array().cast(V.STATE["images"]))
    questions = parts.select("layout", k.alias("place"), ref("p").alias("id"), k.alias("index"), images.alias("images"), some(s % 6 == 0, F.lit("old")).alias("flags"), none.alias("warnings"), F.lit(None).cast("boolean").alias("needs_review"))
    visuals = parts.select("layout", ref("v").alias("ref"), F.lit("stem").alias("role")).unionByName(parts.where(k % 2 == 0).select("layout", ref("w").alias("ref"), F.lit("material").alias("role")))

    def review(n: int, chosen) -> DataFrame:
        text = lambda v: F.lit(v).cast("string")
        asked = F.when((s + n) % 3 == 0, ref("p")).when((s + n) % 3 == 2, F.lit("zz"))
        status = F.when(s % 8 == 0, F.lit("failed")).when(s % 8 == 4, F.lit("partial")).when(s % 8 == 6, F.lit(" Success "))
        summary = F.when((s % 4 != 2) & (F.lit(n) == 1), F.concat(F.lit("s"), (s % 3).cast("string")))
        rest = {"linked_by": text(None), "link_reason": text(None), "role": text(None), "error": text(None)}
        visual = lambda v: F.struct(*[v[c].alias(c) for c in V.VISUAL])
        v = visual(rest | {"visual_id": ref("v"), "belongs": F.lit(True), "summary": summary, "status": status, "confidence": s / 100})
        w = visual(rest | {"visual_id": ref("w"), "belongs": F.lit(True), "summary": text("x"), "status": text("success"), "confidence": F.lit(None).cast("double")})
        values = {
            "question_type": text("t"), "answer": F.when((s + n) % 4 == 0, F.lit("a")).when((s + n) % 4 == 1, F.lit(" B ")).when((s + n) % 4 == 2, F.lit("E")), "answer_confidence": F.when(s % 9 != 0, s % 9 / 10),
            "answer_unknown_reason": F.when(s % 13 == 0, F.lit("no_figure")), "reasoning": text(None), "analysis": text(None), "analysis_unknown_reason": text(None), "question_intent": text(None),
            "can_answer": s % 3 != 0, "missing_context": F.lit(0), "audit_status": F.get(F.array(*[F.lit(x) for x in ("PASSED", "failed", "weird", "passed", "skipped")]), ((s + n) % 5).cast("int")),
            "audit_verdict": text(None), "audit_summary": text(None), "risk_flags": some((s + n) % 4 == 1, F.lit(f"f{n}")), "review_reasons": none, "quality_reasons": none, "needs_review": F.lit(None).cast("boolean"),
        }
        shown = F.when(s % 10 == 0, F.array(v, w)).when(s % 2 == 0, F.array(v)).otherwise(F.array().cast("array<struct<visual_id: string, belongs: boolean, linked_by: string, link_reason: string, role: string, summary: string, status: string, confidence: double, error: string>>"))
        named = F.when(s % 11 != 0, k.cast("string"))
        asked = F.when(s % 11 != 0, asked)
        return parts.where(chosen).select("layout", F.lit(n).alias("page"), F.lit(0).alias("n"), asked.alias("question_id"), named.alias("question_no"), shown.alias("visuals"), *[c.alias(x) for x, c in values.items()])

    reviews = reduce(DataFrame.unionByName, [review(1, s % 5 != 0), review(2, s % 7 == 0)])
    done = V.reviewed(questions, reviews, visuals)
    own = F.filter("images", lambda i: i["ref"].startswith("v"))
    return done.select(
        "layout", F.col("place").alias("k"), F.size("corrections").cast("long").alias("corrections"), F.size(F.filter("corrections", lambda c: c["status"] == "applied")).cast("long").alias("applied"),
        "audit_status", "candidate_answer", "can_solve", F.col("ai_confidence").alias("confidence"), F.size("flags").alias("n_flags"), "needs_review", "visual_status", F.size("images").alias("n_images"),
        F.get(F.transform(own, lambda i: i["summary"]), 0).alias("image_summary"),
    )
