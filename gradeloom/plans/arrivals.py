"""Tasks, whole texts, candidates of answers and proposals of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import arrivals as V
from gradeloom.operators import groups as B
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T


@query("SELECT page, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest, CAST(length(string_agg(line, chr(10) ORDER BY line_no)) AS INTEGER) AS n FROM lin GROUP BY 1")
def full_texts(spark, sf_dir):
    whole = V.full_texts(T.page_lines(spark, sf_dir), "page", "line_no", "line")
    return whole.select("page", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", prelude=False)
def task_list(spark, sf_dir):
    banks = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = T.read(spark, sf_dir, "orders")
    return V.tasks(orders, banks, "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", "o_orderstatus", "c_name")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, 'Brand#' || CAST(l_linenumber AS VARCHAR) AS bank_id, CAST(l_partkey % 70 AS INTEGER) AS question_index,
        l_returnflag = 'R' AS image, l_linestatus = 'O' AS counted, l_suppkey % 4 <> 0 AS anchored FROM lineitem)
    SELECT l_orderkey, l_linenumber, question_index, CASE WHEN image THEN 'image' ELSE 'text' END AS parse_mode,
        NOT (image AND counted AND anchored) OR EXISTS (SELECT 1 FROM part WHERE p_brand = bank_id AND p_size = question_index) AS kept FROM c""", prelude=False)
def sources_kept(spark, sf_dir):
    line = T.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Brand#"), F.col("l_linenumber").cast("string")).alias("bank_id"), (F.col("l_partkey") % 70).cast("int").alias("question_index"),
        F.when(F.col("l_returnflag") == "R", F.lit("image")).otherwise(F.lit("pdf")).alias("parse_mode"),
        F.when(F.col("l_linestatus") == "O", F.lit(V.FALLBACK_TEXT)).alias("raw_text"),
        F.when(F.col("l_suppkey") % 4 != 0, F.lit("顺序题块 1")).alias("question_anchor"),
    )
    questions = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("bank_id"), F.col("p_size").cast("int").alias("index_num"))
    return V.sorted_candidates(line, questions).select("l_orderkey", "l_linenumber", "question_index", "parse_mode", "kept")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name || CASE WHEN p_size % 5 = 0 THEN ' 第二章' ELSE '' END END AS content,
    CASE WHEN p_size % 3 = 0 THEN '|||' WHEN p_size % 2 = 0 THEN 'x|y|z|w' ELSE 'x|y|z|' END AS options,
    CASE WHEN p_size % 3 = 0 THEN 'options_missing' ELSE 'seen' || CASE WHEN p_size % 5 = 0 THEN '|header_footer_blacklist_hit' ELSE '' END
        || CASE WHEN p_size % 2 = 0 THEN '' ELSE '|options_missing' END END AS warnings,
    CASE WHEN p_size % 3 = 0 OR p_size % 7 = 0 THEN 0.0 ELSE 0.25 END AS confidence FROM part""", prelude=False)
def repair_proposals(spark, sf_dir):
    n = F.col("p_size")
    some = lambda c, a, b="": F.when(c, F.lit(a)).otherwise(F.lit(b))
    json = F.concat(
        F.lit('{"content":"'), "p_name", some(n % 5 == 0, " 第二章"), F.lit('","options":{"A":"x","b":"y","C":"z","D":"'), some(n % 2 == 0, "w"),
        F.lit('"},"warnings":["seen","seen"],"confidence":'), some(n % 7 == 0, '"high"', "0.25"), F.lit("}"),
    )
    own = V.repair_proposal(F.when(n % 3 != 0, json), F.col("p_brand"))
    p = T.read(spark, sf_dir, "part").select("p_partkey", own.alias("r"))
    return p.select("p_partkey", "r.content", F.array_join(F.array(*[F.col(f"r.options.{k}") for k in "ABCD"]), "|").alias("options"), F.array_join("r.warnings", "|").alias("warnings"), "r.confidence")


@query(""", s AS (SELECT page, line_no, y0, y0 + 10 AS y1, lead(y0) OVER (PARTITION BY page ORDER BY y0) AS below FROM lin WHERE length(line) % 5 = 0),
    q AS (SELECT page, line_no, y0 FROM lin WHERE length(line) % 5 <> 0 AND length(line) % 3 = 0)
    SELECT page, s.line_no AS seed, count(*) AS n, min(q.line_no) AS first_question, CAST(max(q.y0) + 10 AS DOUBLE) AS end_y, CASE WHEN count(*) > 1 THEN 0.86 ELSE 0.72 END AS confidence,
        min(q.y0) - s.y1 > 120 AS uncertain
    FROM s JOIN q USING (page) WHERE q.y0 >= s.y1 AND (below IS NULL OR q.y0 < below) GROUP BY page, s.line_no, s.y1""")
def downward_groups(spark, sf_dir):
    y = F.col("y0").cast("double")
    lines = T.page_lines(spark, sf_dir).withColumns({"y0": y, "y1": y + 10, "bbox": F.array(F.lit(0.0), y, F.lit(1000.0), y + 10), "n": F.length("line"), "material_key": F.lit(None).cast("string")})
    seeds = lines.where(F.col("n") % 5 == 0).select("page", F.col("line_no").alias("seed"), F.lit("visual").alias("type"), "material_key", "y0", "y1", "bbox", F.lit(200.0).alias("page_height"))
    questions = lines.where((F.col("n") % 5 != 0) & (F.col("n") % 3 == 0)).select("page", F.col("line_no").alias("index"), "y0", "y1", "bbox", "material_key")
    own = B.material_groups(questions, seeds)
    return own.select("page", "seed", F.size("question_indexes").cast("long").alias("n"), F.col("question_indexes")[0].alias("first_question"), "end_y", "confidence", "uncertain")


@query("""SELECT user_id, count(*) AS pages_attempted, coalesce(string_agg(event_id - 1, ',' ORDER BY event_id) FILTER (value > 90), '') AS timeout_pages,
    coalesce(string_agg(event_id - 1, ',' ORDER BY event_id) FILTER (value > 90 OR event_type = 'error'), '') AS failed_pages, count(*) FILTER (event_type <> 'error') AS candidates
    FROM events GROUP BY 1""", prelude=False)
def run_summaries(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok"))
    late = F.when(F.col("value") > 90, F.array(F.lit("vision_page_timeout")))
    pages = T.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("page_num"), status.alias("request_status"), late.alias("page_warnings"))
    own = B.run_summary(pages, "user_id", F.when(F.col("request_status") == "ok", 1).otherwise(0))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return own.select("user_id", "pages_attempted", text("timeout_pages"), text("failed_pages"), F.col("visual_question_candidates").alias("candidates"))
