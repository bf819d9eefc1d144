"""Review queries.  The tables have no questions under review, so their fields are made of part's
columns, alike in Spark and in SQL; the rules are written twice, from the platform's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import images as I
from gradeloom.functions import text as X
from gradeloom.operators import documents as D
from gradeloom.operators import mutations as M
from gradeloom.operators import review as R
from gradeloom.operators import scoring as S
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

Q = """WITH q AS (SELECT p_partkey AS k, p_size AS n, p_name AS content, p_brand AS bank, p_type AS subject, p_retailprice AS price,
    CASE p_partkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' ELSE 'review' END AS status,
    p_size % 5 = 0 AS needs_review, p_size % 7 = 0 AS conflict, p_size % 6 = 0 AS rechecked,
    CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 10) / 10.0 END AS confidence,
    CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN '' END AS answer, CASE p_partkey % 7 WHEN 0 THEN 'because' WHEN 1 THEN '' END AS analysis,
    CASE p_size % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'warning' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' END AS audit,
    CASE WHEN p_size % 9 = 0 THEN ['requires_table'] WHEN p_size % 11 = 0 THEN ['chart_title_missing_or_unlocalized', 'x'] ELSE [] END AS flags,
    CASE p_partkey % 6 WHEN 0 THEN 'ignore_ai_suggestion' WHEN 1 THEN 'accept_ai_suggestion' WHEN 2 THEN '' END AS action
    FROM part)
"""


def one_of(c, values: dict):
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def questions(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return T.read(spark, sf_dir, "part").select(
        k.alias("k"), n.alias("n"), F.col("p_name").alias("content"), F.col("p_brand").alias("bank"), F.col("p_type").alias("subject"), F.col("p_retailprice").alias("price"),
        F.coalesce(one_of(k % 3, {0: "published", 1: "draft"}), F.lit("review")).alias("status"),
        (n % 5 == 0).alias("needs_review"), (n % 7 == 0).alias("conflict"), (n % 6 == 0).alias("rechecked"),
        F.when(k % 4 != 0, (n % 10) / 10).alias("confidence"),
        one_of(k % 5, {0: "A", 1: ""}).alias("answer"), one_of(k % 7, {0: "because", 1: ""}).alias("analysis"),
        one_of(n % 5, {0: "passed", 1: "warning", 2: "failed", 3: "skipped"}).alias("audit"),
        F.when(n % 9 == 0, strings("requires_table")).when(n % 11 == 0, strings("chart_title_missing_or_unlocalized", "x")).otherwise(strings()).alias("flags"),
        one_of(k % 6, {0: "ignore_ai_suggestion", 1: "accept_ai_suggestion", 2: ""}).alias("action"),
    )


@query(Q + """SELECT k, conflict, confidence IS NOT NULL AND confidence < 0.7 AS low_confidence, rechecked, coalesce(action = 'ignore_ai_suggestion', FALSE) AS ignored,
    (coalesce(answer, '') <> '' OR coalesce(analysis, '') <> '' OR coalesce(audit, '') <> '') AND coalesce(action, '') = '' AS unreviewed,
    list_has_any(flags, ['missing_context', 'requires_table', 'requires_chart']) AS high_risk,
    coalesce(action, '') = '' AND (conflict OR coalesce(confidence < 0.7, FALSE) OR list_has_any(flags, ['missing_context', 'requires_table', 'requires_chart'])
        OR coalesce(answer, '') <> '' OR coalesce(analysis, '') <> '') AS unresolved FROM q""", prelude=False)
def workbench_queues(spark, sf_dir):
    q = questions(spark, sf_dir)
    c = [F.col(x) for x in ("answer", "analysis", "audit")]
    queues = R.workbench(F.col("conflict"), F.col("confidence"), F.col("rechecked"), F.col("action"), c, F.col("flags"), c[:2])
    return q.select("k", *[v.alias(n) for n, v in queues.items()])


@query(Q + "SELECT k, needs_review OR n % 4 = 0 OR k % 11 = 0 AS solve FROM q", prelude=False)
def solver_scope(spark, sf_dir):
    n, k = F.col("n"), F.col("k")
    return questions(spark, sf_dir).select("k", R.to_solve(F.col("needs_review"), F.when(n % 4 == 0, 1), F.when(k % 11 == 0, 3).otherwise(0)).alias("solve"))


@query(Q + """SELECT k, n % 2 = 0 AS addable, needs_review AS manual, coalesce(audit = 'failed', FALSE) AS failed, n % 3 = 0 OR conflict AS visual,
    coalesce(answer, '') = '' AS no_answer, coalesce(analysis, '') = '' AS no_analysis FROM q""", prelude=False)
def candidate_tabs(spark, sf_dir):
    n = F.col("n")
    tabs = R.candidate_tabs(n % 2 == 0, F.col("needs_review"), F.col("audit"), F.when(n % 3 == 0, 2), F.col("conflict"), F.col("answer"), F.col("analysis"))
    return questions(spark, sf_dir).select("k", *[v.alias(x) for x, v in tabs.items()])


@query(Q + "SELECT bank, count(*) AS n FROM q WHERE NOT needs_review AND status <> 'published' GROUP BY 1", prelude=False)
def batch_publishable(spark, sf_dir):
    return questions(spark, sf_dir).where(R.batch_publishable(F.col("needs_review"), F.col("status"))).groupBy("bank").agg(F.count(F.lit(1)).alias("n"))


@query(Q + "SELECT k, n, content, bank, status FROM q WHERE status = 'published'", prelude=False)
def student_questions(spark, sf_dir):
    q = questions(spark, sf_dir).where(F.col("status") == "published").withColumnRenamed("confidence", "ai_answer_confidence").withColumnRenamed("flags", "ai_risk_flags")
    return R.for_students(q.select("k", "n", "content", "bank", "status", "answer", "analysis", "ai_answer_confidence", "ai_risk_flags"))


@query("SELECT c_custkey, c_name FROM customer", prelude=False)
def users_without_password(spark, sf_dir):
    return R.without_password(T.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("password")))


@query(Q + """SELECT k, CASE WHEN subject = 'PROMO' THEN 'A=' || content || '|B=' || bank
    ELSE 'A=' || content || '|B=' || bank || '|C=' || coalesce(answer, '') || '|D=' || coalesce(audit, '') END AS options FROM q""", prelude=False)
def options_by_type(spark, sf_dir):
    q = questions(spark, sf_dir)
    o = R.options_by_type(F.when(F.col("subject") == "PROMO", F.lit("judge")).otherwise(F.lit("single")), *[F.col(c) for c in ("content", "bank", "answer", "audit")])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(o)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return q.select("k", shown.alias("options"))


@query(Q + """, c AS (SELECT *, CASE WHEN n % 8 = 0 THEN ['B', 'D'] ELSE [] END AS missing, n % 10 = 3 AS stem_missing, n % 4 < 2 AS has_visual,
        len(flags) > 0 AS visual_risk, k % 3 <> 0 AS reviewable, coalesce(audit, 'failed') AS given FROM q),
    s AS (SELECT *, CASE WHEN given = 'failed' AND NOT stem_missing AND len(missing) = 0 AND has_visual AND k % 2 = 0 THEN 'warning'
        WHEN given = 'passed' AND NOT reviewable THEN 'warning' ELSE given END AS st FROM c),
    m AS (SELECT *, needs_review OR st IN ('failed', 'skipped', 'warning') OR stem_missing OR len(missing) > 0 OR (visual_risk AND NOT has_visual) AS manual,
        list_filter([CASE WHEN stem_missing THEN '题干缺失或包含占位文本' END, CASE WHEN len(missing) > 0 THEN '选项缺失: B,D' END,
            CASE WHEN visual_risk AND NOT has_visual THEN '图表题图片或图表预览缺失' END,
            CASE WHEN st IN ('failed', 'skipped') THEN 'AI 预审核失败: ' || coalesce(nullif(answer, ''), '未给出摘要') END,
            CASE WHEN st = 'warning' AND reviewable THEN 'AI 预审核 warning，需人工核验原卷后才可强制加入' END,
            CASE WHEN NOT reviewable THEN '缺少原卷' END,
            CASE WHEN list_contains(flags, 'chart_title_missing_or_unlocalized') THEN '图表标题缺失或未定位' END], lambda x: x IS NOT NULL) AS reasons FROM s),
    a AS (SELECT *, len(reasons) = 0 AND st = 'passed' AND NOT manual AND reviewable AS can FROM m)
    SELECT k, st AS ai_audit_status, manual AS need_manual_fix, can AS can_add_to_paper, st = 'warning' AND reviewable AND NOT can AS manual_force_add_allowed,
        CASE WHEN can THEN NULL WHEN len(reasons) > 0 THEN array_to_string(reasons, '；') ELSE '未通过自动入卷规则' END AS cannot_add_reason FROM a""", prelude=False)
def paper_candidates(spark, sf_dir):
    q, n, k = questions(spark, sf_dir), F.col("n"), F.col("k")
    none = F.array().cast("array<string>")
    c = {
        "audit": F.col("audit"), "summary": F.col("answer"), "unknown_reason": F.when(k % 2 == 0, F.lit("vision_ai_failed_or_unstructured_output")), "stem_missing": n % 10 == 3,
        "missing": F.when(n % 8 == 0, R.missing_options([F.lit("x"), F.lit(" "), F.lit("y"), F.lit(None).cast("string")])).otherwise(none), "has_visual": n % 4 < 2,
        "visual_risk": F.size("flags") > 0, "flags": F.col("flags"), "reviewable": k % 3 != 0, "context_reason": F.lit("缺少原卷"), "needs_review": F.col("needs_review"),
    }
    return R.candidate(q, c).select("k", "ai_audit_status", "need_manual_fix", "can_add_to_paper", "manual_force_add_allowed", "cannot_add_reason")


@query(Q + """, r AS (SELECT k, n, CASE WHEN n % 9 = 4 THEN content || ' 如下图' ELSE content END AS t, subject FROM q),
    f AS (SELECT *, length(trim(t)) < 12 AS short, subject <> 'PROMO' AND n % 4 = 0 AS gone, n % 9 = 4 AND n % 2 = 0 AND n % 3 <> 0 AS blind, n % 5 = 2 AS warned FROM r)
    SELECT k, NOT (short OR gone OR warned) AS readable, CASE WHEN short OR gone OR warned THEN 0.55 ELSE 0.88 END AS score,
        array_to_string(list_filter([CASE WHEN short THEN '题干过短或缺失' END, CASE WHEN gone THEN '选项缺失：A,C' END, CASE WHEN warned THEN '存在解析警告' END], lambda x: x IS NOT NULL), '|') AS reasons,
        array_to_string(list_filter([CASE WHEN short THEN '重新框选题干区域' END, CASE WHEN gone THEN '重新框选选项区域' END, CASE WHEN warned THEN '根据解析警告复查题干、选项和图片' END], lambda x: x IS NOT NULL), '|') AS prompts,
        NOT (short OR gone OR blind OR warned) AS service_readable,
        array_to_string(list_filter([CASE WHEN short THEN 'stem' END, CASE WHEN gone THEN 'options' END, CASE WHEN blind THEN 'material' END, CASE WHEN blind THEN 'images' END, CASE WHEN warned THEN 'warnings' END], lambda x: x IS NOT NULL), '|') AS focus
    FROM f""", prelude=False)
def readability_reviews(spark, sf_dir):
    q, n = questions(spark, sf_dir), F.col("n")
    text = F.when(n % 9 == 4, F.concat("content", F.lit(" 如下图"))).otherwise(F.col("content"))
    kind = F.when(F.col("subject") == "PROMO", F.lit("judge")).otherwise(F.lit("single"))
    options = [F.when(n % 4 != 0, F.lit("a")), F.lit("b"), F.when(n % 4 != 0, F.lit("c")).otherwise(F.lit("  ")), F.lit("d")]
    warned = F.when(n % 5 == 2, 2).otherwise(0)
    own = q.select("k", R.readability(text, kind, options, warned).alias("a"), R.readability(text, kind, options, warned, F.when(n % 2 == 1, 1), F.when(n % 3 == 0, F.lit("m"))).alias("b"))
    return own.select("k", "a.readable", "a.score", F.array_join("a.reasons", "|").alias("reasons"), F.array_join("a.prompts", "|").alias("prompts"), F.col("b.readable").alias("service_readable"), F.array_join("b.focus_areas", "|").alias("focus"))


@query("""SELECT doc_id, CASE WHEN coalesce(lang, '') <> 'de' AND (length(text) - length(replace(text, 'a', ''))) > 20 AND length(trim(text)) > 5000 THEN 'text' ELSE 'image' END AS mode FROM documents""", prelude=False)
def answer_modes(spark, sf_dir):
    t = F.col("text")
    hits = F.length(t) - F.length(F.replace(t, F.lit("a"), F.lit("")))
    kind = F.when(F.col("lang") == "de", F.lit("scanned_answer_book"))
    return T.read(spark, sf_dir, "documents").select("doc_id", D.answer_mode(hits, F.length(F.trim(t)), F.coalesce(kind, F.lit(""))).alias("mode"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS lines, l_linenumber % 4 AS toc, l_partkey % 40 AS opt, l_partkey % 5 AS que, l_suppkey % 6 AS cha, l_suppkey % 3 AS mat,
        l_partkey % 4 AS exa, l_linenumber % 5 AS img FROM lineitem),
    r AS (SELECT *, CASE WHEN lines % 17 = 0 THEN 0 ELSE lines END AS ln FROM d)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ln = 0 THEN 'visual_heavy' WHEN toc / greatest(ln, 1) > 0.25 THEN 'textbook' WHEN mat >= 2 OR img / 10 > 0.4 THEN 'visual_heavy'
        WHEN exa >= 2 AND opt > 10 THEN 'exam_paper' ELSE 'pure_text' END AS type,
    CASE WHEN ln = 0 THEN 0.5 WHEN toc / greatest(ln, 1) > 0.25 THEN least(0.9, toc / greatest(ln, 1) * 3 ) WHEN mat >= 2 OR img / 10 > 0.4 THEN least(0.9, greatest(mat / 5, img / 10))
        WHEN exa >= 2 AND opt > 10 THEN 0.75 WHEN opt > greatest(que * 3, 8) AND cha < 3 THEN 0.8 ELSE 0.5 END > 0.6 AS sure FROM r""", prelude=False)
def document_types(spark, sf_dir):
    n = F.col("l_quantity").cast("int")
    c = {
        "lines": F.when(n % 17 == 0, 0).otherwise(n), "toc_lines": F.col("l_linenumber") % 4, "options": F.col("l_partkey") % 40, "questions": F.col("l_partkey") % 5, "chapters": F.col("l_suppkey") % 6,
        "materials": F.col("l_suppkey") % 3, "exam_sections": F.col("l_partkey") % 4, "image_pages": F.col("l_linenumber") % 5, "pages": F.lit(10),
    }
    own = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.document_type(c).alias("x"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.type", (F.col("x.confidence") > 0.6).alias("sure"))


BOOK = """WITH b AS (SELECT p_partkey AS k, CASE p_size % 6
        WHEN 0 THEN '【答案】：' || chr(65 + p_size % 4) || '。因为' || p_name
        WHEN 1 THEN '第' || p_size || '题 答案 正确' || chr(10) || '解析：' || p_name
        WHEN 2 THEN '故选 c' WHEN 3 THEN '例 ' || p_size || '：B ' || p_name WHEN 4 THEN p_size || '．D' ELSE p_name END AS t FROM part)
"""


def _book(spark, sf_dir):
    n, name = F.col("p_size"), F.col("p_name")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (n % 4 + 1).cast("int"))
    t = F.when(n % 6 == 0, F.concat(F.lit("【答案】："), letter, F.lit("。因为"), name)).when(n % 6 == 1, F.concat(F.lit("第"), n, F.lit("题 答案 正确\n解析："), name)).when(n % 6 == 2, F.lit("故选 c"))
    t = t.when(n % 6 == 3, F.concat(F.lit("例 "), n, F.lit("：B "), name)).when(n % 6 == 4, F.concat(n, F.lit("．D"))).otherwise(name)
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), n.alias("n"), name.alias("name"), t.alias("t"))


@query(BOOK + """SELECT k, CASE n % 6 WHEN 0 THEN chr(65 + n % 4) WHEN 1 THEN '对' WHEN 2 THEN 'C' WHEN 3 THEN 'B' WHEN 4 THEN 'D' END AS answer,
    CASE n % 6 WHEN 0 THEN '因为' || name WHEN 1 THEN name END AS analysis,
    CASE n % 6 WHEN 1 THEN n WHEN 3 THEN n WHEN 4 THEN n END AS anchor FROM (SELECT p_partkey AS k, p_size AS n, p_name AS name FROM part) JOIN b USING (k)""", prelude=False)
def stated_answers(spark, sf_dir):
    return _book(spark, sf_dir).select("k", X.stated_answer(F.col("t")).alias("answer"), X.stated_analysis(F.col("t")).alias("analysis"), F.get(X.anchors_in(F.col("t")), F.lit(0))["index"].alias("anchor"))


@query(Q + """, s AS (SELECT k, 30 + CASE WHEN coalesce(answer, '') <> '' THEN 30 ELSE 0 END + CASE WHEN coalesce(analysis, '') <> '' THEN 20 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 10 ELSE 0 END
        + CASE WHEN length(analysis) BETWEEN 8 AND 3000 THEN 10 ELSE 0 END AS s0, coalesce(answer, '') = '' AS na, coalesce(analysis, '') = '' AS no, n FROM q)
    SELECT k, CAST(least(s0, CASE WHEN na THEN 40 ELSE 100 END, CASE WHEN n % 4 > 1 THEN 60 ELSE 100 END, CASE WHEN no THEN 70 ELSE 100 END, CASE WHEN n % 13 = 0 THEN 75 ELSE 100 END) AS INTEGER) AS score FROM s""", prelude=False)
def answer_text_scores(spark, sf_dir):
    n = F.col("n")
    return questions(spark, sf_dir).select("k", R.answer_text_score(F.col("answer"), F.col("analysis"), F.when(n % 2 == 0, F.lit("s")), n % 13, n % 4).alias("score"))


@query(Q + """, s AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'B' WHEN p_size % 3 = 0 THEN '' END AS sa FROM part)
    SELECT k, coalesce(nullif(sa, ''), nullif(answer, '')) AS answer FROM q JOIN s USING (k)""", prelude=False)
def sources_applied(spark, sf_dir):
    n = F.col("n")
    return questions(spark, sf_dir).select("k", R.source_applied(F.when(n % 2 == 0, F.lit("B")).when(n % 3 == 0, F.lit("")), F.col("answer")).alias("answer"))


@query(Q + """, o AS (SELECT k, answer, analysis, bank AS image, n AS answer_source_id, confidence AS match_confidence FROM q),
    s AS (SELECT DISTINCT n AS source_id, 'A' AS s_answer, CASE WHEN n % 2 = 0 THEN 'because' END AS s_analysis, 'Brand#3' AS s_image FROM q WHERE n % 3 = 0)
    SELECT k, CASE WHEN source_id IS NOT NULL AND answer IS NOT DISTINCT FROM s_answer THEN NULL ELSE answer END AS answer,
        CASE WHEN source_id IS NOT NULL AND analysis IS NOT DISTINCT FROM s_analysis THEN NULL ELSE analysis END AS analysis,
        CASE WHEN source_id IS NOT NULL AND image IS NOT DISTINCT FROM s_image THEN NULL ELSE image END AS image,
        CASE WHEN source_id IS NULL THEN answer_source_id END AS answer_source_id, CASE WHEN source_id IS NULL THEN match_confidence END AS match_confidence
    FROM o LEFT JOIN s ON source_id = answer_source_id""", prelude=False)
def sources_unbound(spark, sf_dir):
    q, n = questions(spark, sf_dir), F.col("n")
    own = q.select("k", "answer", "analysis", F.col("bank").alias("image"), n.alias("answer_source_id"), F.col("confidence").alias("match_confidence"))
    gone = q.where(n % 3 == 0).select(n.alias("source_id"), F.lit("A").alias("s_answer"), F.when(n % 2 == 0, F.lit("because")).alias("s_analysis"), F.lit("Brand#3").alias("s_image")).distinct()
    return R.unbound(own, gone)


@query(Q + """SELECT k, n % 4 = 0 OR len(flags) > 0 AS depends, n % 7 = 0 OR (n % 2 = 0 AND (n % 3 = 0 OR n % 5 = 0)) AS evidence FROM q""", prelude=False)
def material_predicates(spark, sf_dir):
    q, n = questions(spark, sf_dir), F.col("n")
    flags = F.transform("flags", lambda f: F.concat(f, F.lit("：图表")))
    depends = R.material_dependent(F.concat("content", F.when(n % 4 == 0, F.lit("的比重")).otherwise(F.lit(""))), flags)
    one = lambda m: F.when(n % m == 0, 1).otherwise(0)
    return q.select("k", depends.alias("depends"), R.material_evidence(F.when(n % 7 == 0, F.lit("m")), one(2), one(3), one(5)).alias("evidence"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, s_name AS material_name, s_suppkey IS NOT NULL AS has_material FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + 5""", prelude=False)
def question_materials(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") + 5).alias("s_suppkey"))
    both = R.with_material(lines, T.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.col("material.s_name").alias("material_name"), F.col("material").isNotNull().alias("has_material"))


@query("""SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'FURNITURE'""", prelude=False)
def selected_banks(spark, sf_dir):
    banks = T.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("draft")).otherwise(F.lit("published")).alias("status"))
    chosen = T.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return R.selected_banks(chosen, banks, "c_custkey").select("o_orderkey", "c_custkey", "c_name")


ANSWERS = Q + """, r AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'C' END AS ra, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS ua, p_size % 8 = 0 AS ic FROM part WHERE p_size > 10),
    v AS (SELECT k, bank, coalesce(nullif(ra, ''), nullif(answer, ''), '') AS answer, coalesce(ua, '') AS user_answer,
        coalesce(ic, FALSE) OR coalesce(nullif(ra, ''), nullif(answer, ''), '') = coalesce(ua, '') AS is_correct FROM q LEFT JOIN r USING (k))
"""


def _quiz(spark, sf_dir):
    q, n = questions(spark, sf_dir), F.col("p_size")
    r = T.read(spark, sf_dir, "part").where(n > 10).select(F.col("p_partkey").alias("k"), F.when(n % 4 == 0, F.lit("C")).alias("answer"), one_of(n % 3, {0: "A", 1: "C"}).alias("user_answer"), (n % 8 == 0).alias("is_correct"))
    return q, R.quiz_review(q, r, "k")


@query(ANSWERS + "SELECT k, answer, user_answer, is_correct FROM v", prelude=False)
def quiz_review(spark, sf_dir):
    return _quiz(spark, sf_dir)[1]


@query(ANSWERS + """, g AS (SELECT bank, count(*) AS total, count(*) FILTER (user_answer <> '' AND is_correct) AS correct, count(*) FILTER (user_answer <> '' AND NOT is_correct) AS wrong FROM v GROUP BY 1)
    SELECT bank, total, correct, wrong, total - correct - wrong AS unanswered, CAST(floor(correct * 100 / total + 0.5) AS BIGINT) AS accuracy FROM g""", prelude=False)
def quiz_results(spark, sf_dir):
    q, r = _quiz(spark, sf_dir)
    return R.quiz_result(r.join(q.select("k", "bank"), "k"), "bank", F.col("user_answer"), F.col("is_correct"))


@query(Q + "SELECT subject, count(*) AS total, count(DISTINCT bank) AS banks FROM q WHERE status = 'published' GROUP BY 1", prelude=False)
def filtered_totals(spark, sf_dir):
    return questions(spark, sf_dir).where(F.col("status") == "published").groupBy("subject").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("bank").alias("banks"))


@query(Q + "SELECT DISTINCT bank FROM q WHERE n % 10 = 1", prelude=False)
def affected_banks(spark, sf_dir):
    return questions(spark, sf_dir).where(F.col("n") % 10 == 1).select("bank").distinct()


@query(Q + """, g AS (SELECT bank, count(*) FILTER (audit IS NOT NULL) AS total, count(*) FILTER (audit IS NOT NULL AND needs_review) AS needs_review,
        count(*) FILTER (audit IS NOT NULL AND n % 3 = 0) AS with_images, count(*) AS candidates FROM q GROUP BY 1)
    SELECT *, greatest(0, candidates - total) AS rejected, with_images > 0 AS has_images, total = 0 AS zero_questions FROM g""", prelude=False)
def parse_stats(spark, sf_dir):
    return R.parse_stats(questions(spark, sf_dir), "bank", F.col("audit").isNotNull(), F.col("needs_review"), F.when(F.col("n") % 3 == 0, 1))


@query("SELECT l_returnflag, count(*) AS total_candidates, round(avg(l_quantity), 1) AS avg_confidence FROM lineitem GROUP BY 1", prelude=False)
def answer_book_stats(spark, sf_dir):
    return R.answer_book_stats(T.read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS provider, CAST(event_id % 4 AS VARCHAR) AS model FROM events),
    p AS (SELECT user_id, trim(provider) AS v, min(event_id) AS f FROM c WHERE trim(provider) <> '' GROUP BY 1, 2), m AS (SELECT user_id, model AS v, min(event_id) AS f FROM c GROUP BY 1, 2)
    SELECT user_id, coalesce((SELECT string_agg(v, '|' ORDER BY f) FROM p WHERE p.user_id = u.user_id), '') AS providers, (SELECT string_agg(v, '|' ORDER BY f) FROM m WHERE m.user_id = u.user_id) AS models
    FROM (SELECT DISTINCT user_id FROM c) u""", prelude=False)
def call_stats(spark, sf_dir):
    e = F.col("event_id")
    calls = T.read(spark, sf_dir, "events").select("user_id", e, F.when(e % 5 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("provider"), (e % 4).cast("string").alias("model"))
    return R.call_stats(calls, "user_id", "event_id").select("user_id", F.array_join("providers", "|").alias("providers"), F.array_join("models", "|").alias("models"))


@query("""WITH v AS (SELECT p_partkey AS k, p_size AS n, p_name AS name, p_brand AS brand FROM part)
    SELECT k, CASE WHEN n % 5 = 0 THEN 'skipped' WHEN n % 3 = 0 THEN 'failed' ELSE 'partial' END AS status,
        CASE WHEN n % 5 <> 0 AND n % 3 <> 0 THEN CASE WHEN n % 2 = 0 THEN name || chr(10) || brand ELSE name END END AS summary,
        CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN 'timeout' WHEN n % 3 = 0 THEN '视觉解析未返回结构化图表摘要' END AS error,
        CASE WHEN n % 5 <> 0 AND (n % 2 = 0 OR n % 4 = 1) THEN CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.25 END END AS confidence FROM v""", prelude=False)
def visual_defaults(spark, sf_dir):
    n = F.col("p_size")
    said, null = n % 3 != 0, F.lit(None).cast("string")
    image = lambda summary, description, error, confidence: F.struct(F.when(said, summary).alias("summary"), F.when(said, description).alias("description"), error.alias("error"), confidence.alias("confidence"))
    one = image(F.col("p_name"), F.lit("z"), F.when(n % 7 == 0, F.lit("timeout")), F.when(n % 4 == 1, F.lit(0.25)))
    two = image(F.lit(""), F.when(n % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), F.when(n % 7 == 0, F.lit("timeout")).otherwise(null), F.when(n % 2 == 0, F.lit(0.5)))
    own = R.visual_defaults(F.when(n % 5 != 0, F.array(one, two)))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), own.alias("x")).select("k", "x.*")


@query(Q + """, f AS (SELECT *, list_concat(flags, CASE WHEN n % 4 = 0 AND n % 8 = 0 THEN ['视觉解析失败，需人工复核'] ELSE [] END) AS fl, n % 4 = 0 AS hv, coalesce(answer, '') <> '' OR coalesce(analysis, '') <> '' AS said FROM q),
    w AS (SELECT *, len(fl) > 0 OR coalesce(confidence < 0.7, FALSE) AS warning FROM f)
    SELECT k, CASE WHEN audit IS NOT NULL THEN audit WHEN said THEN CASE WHEN warning THEN 'warning' ELSE 'passed' END WHEN hv THEN 'failed' ELSE 'skipped' END AS ai_audit_status,
        CASE WHEN audit IS NULL THEN coalesce(answer, '') <> '' AND coalesce(analysis, '') <> '' END AS can_solve,
        needs_review OR (audit IS NULL AND (NOT said OR warning)) AS needs_review,
        array_to_string(list_concat(fl, CASE WHEN audit IS NULL AND NOT said THEN ['AI 预审核未完成，需人工复核'] ELSE [] END), '|') AS flags FROM w""", prelude=False)
def preaudit_defaults(spark, sf_dir):
    q, n = questions(spark, sf_dir), F.col("n")
    c = {"audit": F.col("audit"), "answer": F.col("answer"), "analysis": F.col("analysis"), "confidence": F.col("confidence"), "has_visual": n % 4 == 0, "visual_failed": n % 8 == 0, "needs_review": F.col("needs_review"), "flags": F.col("flags")}
    return R.preaudit(q, c).select("k", "ai_audit_status", "can_solve", "needs_review", F.array_join("ai_risk_flags", "|").alias("flags"))


@query(Q + "SELECT k, CASE WHEN answer = 'A' THEN 'A' END AS answer, CASE WHEN n % 3 = 0 THEN 0.5 END AS confidence FROM q", prelude=False)
def answer_suggestions(spark, sf_dir):
    own = R.answer_suggestion(F.when(F.col("answer") == "A", F.lit(" a ")).otherwise(F.lit("E")), F.when(F.col("n") % 3 == 0, F.lit("0.5")).otherwise(F.lit("high")))
    return questions(spark, sf_dir).select("k", own.alias("x")).select("k", "x.*")


def _image(**fields):
    """An image with these fields."""
    return I.image(**fields)


def _images(spark, sf_dir):
    n, k = F.col("n"), F.col("k").cast("string")
    role = F.element_at(F.array(*[F.lit(x) for x in ("material", "option_a", "chart", "other")]), (n % 4 + 1).cast("int"))
    one = _image(url=F.concat(F.lit("u"), k), role=role, belongs_to_question=n % 2 == 0)
    two = _image(url=F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), k)), ref=F.lit("r"), slot=F.when(n % 5 == 0, F.lit("解析")), same_visual_group_id=F.when(n % 7 == 0, F.lit("old")))
    three = _image(base64=F.lit("x"), ref=F.when(n % 2 == 0, F.lit("r")).otherwise(F.lit("s")), image_role=F.lit("given"), image_order=F.lit(9))
    return questions(spark, sf_dir).select("k", "n", F.array(one, two, three).alias("a"))


@query(Q + """SELECT k, CASE WHEN n % 3 = 0 THEN 2 ELSE 3 END AS n_images,
    CASE n % 4 WHEN 0 THEN 'material' WHEN 1 THEN 'option_image' WHEN 2 THEN 'question_visual' ELSE 'unknown' END || '|unknown|given' AS roles, '1|2|9' AS orders,
    CASE WHEN n % 2 = 0 THEN CAST(k AS VARCHAR) END AS linked, CASE WHEN n % 5 = 0 AND n % 3 <> 0 THEN 1 ELSE 0 END AS in_analysis, CASE WHEN n % 2 = 0 THEN 2 ELSE 3 END AS distinct_refs FROM q""", prelude=False)
def image_arrays(spark, sf_dir):
    a = F.col("a")
    found = I.parsed(a)
    return _images(spark, sf_dir).select(
        "k", F.size(I.images_of(a)).alias("n_images"), F.array_join(F.transform(found, lambda i: i["image_role"]), "|").alias("roles"), F.array_join(F.transform(found, lambda i: i["image_order"].cast("string")), "|").alias("orders"),
        I.linked(a, F.col("k"))[0]["linked_question_id"].alias("linked"), F.size(I.in_slot(a, "analysis")).alias("in_analysis"), F.size(I.distinct_refs(a)).alias("distinct_refs"),
    )


@query(Q + """SELECT k, CASE WHEN n % 3 = 0 THEN 3 ELSE 4 END AS after_add, CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END AS after_move,
    '1' || CASE WHEN n % 3 = 0 THEN '' ELSE '|2' END AS orders, 'u' || k || '/' || k AS arrived, CASE WHEN n % 3 = 0 THEN 'g|g' WHEN n % 7 = 0 THEN 'old|old|-' ELSE 'g|g|-' END AS groups FROM q""", prelude=False)
def image_changes(spark, sf_dir):
    a, k = F.col("a"), F.col("k").cast("string")
    key = F.concat(F.lit("u"), k)
    own, other = I.moved(a, F.array().cast(f"array<{I.IMAGE}>"), key, F.col("k"))
    grouped = I.grouped(a, key, F.lit("g"))
    return _images(spark, sf_dir).select(
        "k", F.size(I.added(a, _image(url=F.lit("new")))).alias("after_add"), F.size(own).alias("after_move"), F.array_join(F.transform(own, lambda i: i["image_order"].cast("string")), "|").alias("orders"),
        F.concat(other[0]["url"], F.lit("/"), other[0]["moved_from_question_id"]).alias("arrived"), F.array_join(F.transform(grouped, lambda i: F.coalesce(i["same_visual_group_id"], F.lit("-"))), "|").alias("groups"),
    )


@query(Q + "SELECT k, n, price FROM q ORDER BY n NULLS LAST, price, k LIMIT 20 OFFSET 20", prelude=False)
def answer_source_page(spark, sf_dir):
    """A page of a list is the feature."""
    return questions(spark, sf_dir).orderBy(F.col("n").asc_nulls_last(), "price", "k").offset(20).limit(20).select("k", "n", "price")


@query("""SELECT page, line_no, row_number() OVER (PARTITION BY page ORDER BY y0, length(line), line_no) AS place FROM lin""")
def reading_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("page").orderBy("y0", F.length("line"), "line_no"))
    return T.page_lines(spark, sf_dir).select("page", "line_no", place.cast("long").alias("place"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_partkey % 3 AS b FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, b ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM r)
    SELECT l_orderkey, l_returnflag, b, l_linenumber, l_partkey FROM d WHERE n = 1 OR b = 0""", prelude=False)
def region_dedupe(spark, sf_dir):
    """Regions by (type, box, page) once each; those without a box (null) are their own."""
    b = F.col("l_partkey") % 3
    rows = T.read(spark, sf_dir, "lineitem")
    out = R.first_of(rows, [F.col("l_orderkey"), F.col("l_returnflag"), F.when(b != 0, b)], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return out.select("l_orderkey", "l_returnflag", b.alias("b"), "l_linenumber", "l_partkey")


@query("""WITH a AS (SELECT p_partkey AS k, p_brand, p_size, round(p_retailprice / 100) AS y FROM part)
    SELECT min(k) AS k, p_brand, p_size, CAST(y AS BIGINT) AS y FROM a GROUP BY p_brand, p_size, y""", prelude=False)
def anchor_dedupe(spark, sf_dir):
    y = F.round(F.col("p_retailprice") / 100).cast("long")
    rows = T.read(spark, sf_dir, "part").withColumn("y", y)
    return R.first_of(rows, [F.col("p_brand"), F.col("p_size"), F.col("y")], [F.col("p_partkey")]).select(F.col("p_partkey").alias("k"), "p_brand", "p_size", "y")


LINES = """WITH t AS (SELECT p_partkey AS k, p_size AS n, p_name AS name, p_brand AS brand FROM part)
"""


def _block(spark, sf_dir):
    n, name = F.col("p_size"), F.col("p_name")
    head = F.when(n % 3 == 0, F.lit("第一章 数量\n")).otherwise(F.lit(""))
    t = F.concat(head, F.lit("  "), name, F.lit("\n\nA. one\nB．"), F.col("p_brand"), F.lit("\n A、two "), F.when(n % 2 == 0, F.lit("\nrest of  it")).otherwise(F.lit("")))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), t.alias("t"), name.alias("name"), n.alias("n"))


@query(LINES + """SELECT k, CASE WHEN n % 3 = 0 THEN '第一章 数量' || chr(10) ELSE '' END || name || CASE WHEN n % 2 = 0 THEN chr(10) || 'rest of  it' ELSE '' END AS stem,
    'A=two|B=' || brand AS options, name || ' A. one B．' || brand || ' A、two' || CASE WHEN n % 2 = 0 THEN ' rest of it' ELSE '' END AS one_line, n % 3 = 0 AS noise FROM t""", prelude=False)
def option_lines(spark, sf_dir):
    own = _block(spark, sf_dir).withColumn("x", X.split_options(F.col("t")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("x.options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return own.select("k", "x.stem", shown.alias("options"), X.stem_on_one_line(F.col("t")).alias("one_line"), F.rlike("t", F.lit(R.HEADER_NOISE)).alias("noise"))


@query(LINES + """SELECT k, CASE WHEN n % 2 = 0 THEN '例 ' || n || ' ' || name ELSE '第' || n || '题' || name END || '|A.one|B、' || brand AS lines FROM t""", prelude=False)
def logical_lines(spark, sf_dir):
    n, name = F.col("p_size"), F.col("p_name")
    t = F.concat(F.when(n % 2 == 0, F.concat(F.lit("例 "), n, F.lit(" "), name)).otherwise(F.concat(F.lit("第"), n, F.lit("题"), name)), F.lit(" A.one B、"), F.col("p_brand"))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(X.logical_lines(t), "|").alias("lines"))


@query("""SELECT l_orderkey, min(l_linenumber) AS page FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""", prelude=False)
def first_answer_page(spark, sf_dir):
    return T.read(spark, sf_dir, "lineitem").where(X.contains_any(F.col("l_returnflag"), ["R"])).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("page"))


@query("""SELECT doc_id, length(trim(coalesce(text, ''))) = 0 OR (doc_id % 7) / 10 > 0.35 OR contains(coalesce(text, ''), 'License') OR (contains(coalesce(text, ''), 'password') AND doc_id % 3 = 0 AND doc_id % 5 < 2) AS skip FROM documents""", prelude=False)
def skipped_pages(spark, sf_dir):
    d, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return T.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", D.skip_page(t, F.lit(10), d % 7, F.contains(t, F.lit("License")), F.contains(t, F.lit("password")), d % 3, d % 5).alias("skip"))


@query("""WITH s AS (SELECT l_orderkey AS page, max(l_quantity) AS y1 FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_quantity > y1 + 4, FALSE) AS after_last FROM lineitem LEFT JOIN s ON page = l_orderkey""", prelude=False)
def visuals_after_sources(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem")
    sources = lines.where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y1"))
    visuals = lines.select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("y0"))
    return R.after_last_source(visuals, sources).select(F.col("page").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "after_last")


@query("""WITH b AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 60 AS DOUBLE) AS m FROM part)
    SELECT k, greatest(0, least(s + 40, m + 50) - greatest(s, m)) / greatest(1, least(40, 50)) > 0.6 AND greatest(0, 100 + m - 120) <= 500 * 0.08 AND NOT (130 >= 120 AND 130 <= 100 + m) AS merge,
        (least(120, 100 + m) - 0.5 <= 130 AND 140 <= greatest(120, 100 + m) + 0.5) AS blocked FROM b""", prelude=False)
def visual_merges(spark, sf_dir):
    s, m = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    box = lambda x0, y0, x1, y1: F.struct(*[(v if not isinstance(v, float) else F.lit(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    merge = R.can_merge(box(s, 20.0, s + 40, 120.0), box(m, 100 + m, m + 50, 300.0), F.lit(500.0), F.array(box(0.0, 130.0, 10.0, 140.0)))
    block = R.blocked(F.lit(120.0), 100 + m, F.array(F.struct(F.lit(130.0).alias("y0"), F.lit(140.0).alias("y1"), F.lit("option").alias("role")), F.struct(F.lit(125.0).alias("y0"), F.lit(126.0).alias("y1"), F.lit("text").alias("role"))))
    return T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), merge.alias("merge"), block.alias("blocked"))


@query(Q + "SELECT bank, count(*) FILTER (audit = 'passed' AND NOT conflict) AS published_count, count(*) FILTER (NOT coalesce(audit = 'passed' AND NOT conflict, FALSE)) AS review_count, count(*) FILTER (NOT coalesce(audit = 'passed' AND NOT conflict, FALSE)) AS skipped_count FROM q GROUP BY 1", prelude=False)
def published_tasks(spark, sf_dir):
    return R.published(questions(spark, sf_dir), (F.col("audit") == "passed") & ~F.col("conflict"), "bank")[1]


@query(Q + "SELECT k, CASE WHEN audit = 'passed' AND NOT conflict THEN 'published' ELSE status END AS status, needs_review AND NOT coalesce(audit = 'passed' AND NOT conflict, FALSE) AS needs_review FROM q", prelude=False)
def published_questions(spark, sf_dir):
    return R.published(questions(spark, sf_dir), (F.col("audit") == "passed") & ~F.col("conflict"), "bank")[0].select("k", "status", "needs_review")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN l_suppkey END AS s_suppkey FROM lineitem", prelude=False)
def unlinked_questions(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    return R.unlinked(lines, T.read(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0), "s_suppkey")


@query(Q + "SELECT k, 'accept|' || CASE WHEN coalesce(action, '') <> '' THEN action ELSE 'none' END AS logs FROM q", prelude=False)
def action_logs(spark, sf_dir):
    own = F.array(F.when(R.filled(F.col("action")), F.col("action")).otherwise(F.lit("none")), F.lit("older"))
    return questions(spark, sf_dir).select("k", F.array_join(R.with_log(own, F.lit("accept"), 2), "|").alias("logs"))


MATCHES = r"""WITH q AS (SELECT p_partkey AS question_id, p_brand AS bank_id, p_size AS index_num, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS anchor, p_name || ' alpha beta gamma delta' AS text FROM part),
    s AS (SELECT s_suppkey AS source_id, 'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) AS bank_id, CAST(1 + s_suppkey % 50 AS INTEGER) AS question_index, CASE WHEN s_suppkey % 3 > 0 THEN 'PROMO' END AS anchor,
        CASE WHEN s_suppkey % 2 = 0 THEN 'widget alpha beta gamma delta' ELSE 'nothing' END AS text, s_suppkey % 100 AS confidence, s_suppkey % 9 = 0 AS fb FROM supplier),
    tq AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM q), ts AS (SELECT source_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM s),
    z AS (SELECT question_id, count(*) AS size FROM tq GROUP BY 1),
    j AS (SELECT s.*, q.question_id, q.anchor AS qa, contains(q.text, 'alpha') AS section, size, (SELECT count(*) FROM tq JOIN ts USING (w) WHERE tq.question_id = q.question_id AND ts.source_id = s.source_id) AS shared,
        count(q.question_id) OVER (PARTITION BY s.source_id) AS n FROM s LEFT JOIN q ON q.bank_id = s.bank_id AND q.index_num = s.question_index LEFT JOIN z ON z.question_id = q.question_id),
    e AS (SELECT *, CASE WHEN shared >= 10 AND shared / least(size, 30) >= 0.35 THEN 35 WHEN shared >= 6 AND shared / least(size, 30) >= 0.25 THEN 25 WHEN shared >= 3 AND shared / least(size, 30) >= 0.15 THEN 15 ELSE 0 END AS ev FROM j),
    a AS (SELECT *, 45 + CASE WHEN section THEN 10 ELSE 0 END + CASE WHEN anchor = qa THEN 20 ELSE 0 END + ev + CASE WHEN confidence >= 85 THEN 5 ELSE 0 END + CASE WHEN n = 1 THEN 10 ELSE 0 END AS t FROM e),
    b AS (SELECT *, CASE WHEN n > 1 THEN least(t, 70) ELSE t END AS t2 FROM a),
    c AS (SELECT *, CAST(CASE WHEN question_id IS NULL THEN 0 WHEN fb THEN 60 WHEN ev < 20 AND anchor IS DISTINCT FROM qa THEN least(t2, 60) ELSE least(t2, 100) END AS INTEGER) AS score FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, question_id) AS place FROM c)
    SELECT source_id, question_id, n AS candidates, score, CASE WHEN fb AND n = 0 THEN 'ignored' WHEN fb THEN 'ambiguous' WHEN n = 0 THEN 'unmatched' WHEN n = 1 AND score >= 85 THEN 'matched' WHEN score >= 70 THEN 'ambiguous' ELSE 'unmatched' END AS status
    FROM r WHERE place = 1"""


@query(MATCHES, prelude=False)
def matched_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    q = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("bank_id"), F.col("p_size").alias("index_num"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).alias("anchor"), F.concat("p_name", F.lit(" alpha beta gamma delta")).alias("text"))
    s = T.read(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.concat(F.lit("Brand#"), (1 + k % 5).cast("string")).alias("bank_id"), (1 + k % 50).cast("int").alias("question_index"), F.lit("alpha").alias("section_key"),
        F.when(k % 3 > 0, F.lit("PROMO")).alias("question_anchor"), F.when(k % 2 == 0, F.lit("widget alpha beta gamma delta")).otherwise(F.lit("nothing")).alias("text"), (k % 100).cast("double").alias("confidence"), (k % 9 == 0).alias("is_fallback"),
    )
    return S.matched_sources(s, q)
