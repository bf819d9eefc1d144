"""Filters, joins, windows, sets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import arrays as A
from gradeloom.functions import text as X
from gradeloom.operators import joins as J
from gradeloom.operators import mutations as M
from gradeloom.operators import paging as P
from gradeloom.operators import versions as N
from gradeloom.operators import windows as W
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T
from gradeloom.sources import writers as K


@query("""SELECT qid, bank_id, subject, content, index_num FROM que
    WHERE subject <> 'PROMO' AND content LIKE '%e%' ORDER BY index_num DESC NULLS LAST, qid LIMIT 10 OFFSET 10""")
def question_list(spark, sf_dir):
    q = T.questions(spark, sf_dir)
    rows = P.where_all(q, P.equal("bank_id", None), F.col("subject") != "PROMO", X.like(F.col("content"), "e"), P.equal("index_num", None))
    return P.page(rows, P.sorted_by(rows, "index_num", "DESC", "qid"), 2, 10).select("qid", "bank_id", "subject", "content", "index_num")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_name LIKE '%99%' OR CAST(c_custkey AS VARCHAR) LIKE '%12%')", prelude=False)
def user_list(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer")
    return P.where_all(c, P.equal("c_mktsegment", "BUILDING"), X.like(F.col("c_name"), "99") | X.like(F.col("c_custkey").cast("string"), "12")).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' OR CAST(p_size AS VARCHAR) LIKE '%ring%'", prelude=False)
def keyword_search(spark, sf_dir):
    return T.read(spark, sf_dir, "part").where(X.search("RING", *[F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")])).select("p_partkey")


@query("SELECT id, user_id, bank_id, is_correct FROM both_ WHERE bank_id = 'Brand#4' AND NOT is_correct")
def user_records(spark, sf_dir):
    r, q = T.records(spark, sf_dir), T.questions(spark, sf_dir)
    both = r.join(q, r["question_id"] == q["qid"], "left")
    return P.where_all(both, P.equal("bank_id", "Brand#4"), ~F.col("is_correct")).select("id", "user_id", "bank_id", "is_correct")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'", prelude=False)
def sources_not_ignored(spark, sf_dir):
    return T.read(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 5, 8, 13, 21, 34, 55, 89)", prelude=False)
def orders_by_ids(spark, sf_dir, ids=(3, 5, 8, 13, 21, 34, 55, 89)):
    """The feature is a list of ids: it is a parameter."""
    return T.read(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(*ids)).select("o_orderkey", "o_orderstatus")


@query("""SELECT user_id, question_id, id, is_correct FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY created_at DESC, id DESC) AS n FROM rec) WHERE n = 1""")
def latest_attempt(spark, sf_dir):
    return W.latest(T.records(spark, sf_dir), ["user_id", "question_id"], "created_at", "id").select("user_id", "question_id", "id", "is_correct")


@query(""", w AS (SELECT *, max(created_at) OVER (PARTITION BY user_id, question_id) AS newest,
        row_number() OVER (PARTITION BY user_id, question_id ORDER BY created_at) AS n FROM rec
        WHERE NOT is_correct AND NOT removed_from_wrong AND NOT is_mastered),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, id) AS position FROM w WHERE n = 1)
    SELECT user_id, question_id, id, created_at, newest, CAST(position AS INTEGER) AS position FROM p WHERE position BETWEEN 3 AND 4""")
def wrong_book(spark, sf_dir):
    r = T.records(spark, sf_dir).where(~F.col("is_correct") & ~F.col("removed_from_wrong") & ~F.col("is_mastered"))
    rows = W.wrong_book(r, ["user_id"], "question_id", "created_at")
    return P.page_in_group(rows, ["user_id"], [F.desc("newest"), F.asc("id")], 2, 2).select("user_id", "question_id", "id", "created_at", "newest", "position")


@query(""", w AS (SELECT DISTINCT user_id, question_id FROM rec JOIN que ON question_id = qid WHERE NOT is_correct AND NOT removed_from_wrong AND NOT is_mastered)
    SELECT user_id, least(count(*), 5) AS n FROM w GROUP BY 1""")
def wrong_practice_size(spark, sf_dir):
    """The draw itself is random; how many are drawn is not."""
    r = T.records(spark, sf_dir).where(~F.col("is_correct") & ~F.col("removed_from_wrong") & ~F.col("is_mastered"))
    rows = W.wrong_book(r, ["user_id"], "question_id", "created_at").join(T.questions(spark, sf_dir).select(F.col("qid").alias("question_id")), "question_id", "left_semi")
    drawn = P.first_per_group(rows, ["user_id"], [F.rand(7)], 5)
    return drawn.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""", prelude=False)
def neighbours(spark, sf_dir):
    return W.neighbours(T.read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "role").select("conv_id", "turn", "previous", "next")


@query("""SELECT conv_id, string_agg(role, '|' ORDER BY turn DESC, role, text) AS latest FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 5 GROUP BY 1""", prelude=False)
def logs_top5(spark, sf_dir):
    out = W.top_list(T.read(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.asc("role"), F.asc("text")], "role", 5, "latest")
    return out.withColumn("latest", F.array_join("latest", "|"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 48)", prelude=False)
def semi_used_materials(spark, sf_dir):
    used = T.read(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).select(F.col("l_suppkey").alias("s_suppkey"))
    return T.read(spark, sf_dir, "supplier", "s_suppkey").join(used, "s_suppkey", "left_semi")


@query("SELECT DISTINCT question_id FROM rec WHERE question_id NOT IN (SELECT qid FROM que)")
def anti_unknown_refs(spark, sf_dir):
    return J.missing(T.records(spark, sf_dir).select("question_id"), T.questions(spark, sf_dir).select(F.col("qid").alias("question_id")), "question_id").distinct()


@query("SELECT count(DISTINCT question_id) AS unknown, count(DISTINCT question_id) = 0 AS ok FROM rec WHERE question_id NOT IN (SELECT qid FROM que)")
def selection_check(spark, sf_dir):
    return J.is_valid_selection(T.records(spark, sf_dir).select("question_id"), T.questions(spark, sf_dir).select(F.col("qid").alias("question_id")), "question_id")


RANGES = """, rng AS (SELECT page, line_no AS low, line_no + 1 + length(line) % 7 AS high, line_no AS ord FROM lin WHERE length(line) % 5 = 0),
    hit AS (SELECT l.page, l.line_no, r.low, r.high, r.ord FROM lin l LEFT JOIN rng r ON l.page = r.page AND l.line_no BETWEEN r.low AND r.high)
"""


def _ranges(lines):
    n = F.length("line")
    return lines.where(n % 5 == 0).select("page", F.col("line_no").alias("low"), (F.col("line_no") + 1 + n % 7).alias("high"), F.col("line_no").alias("ord"))


@query(RANGES + "SELECT page, line_no, min(ord) AS ord, min_by(high, ord) AS high FROM hit GROUP BY 1, 2")
def range_join_first(spark, sf_dir):
    lines = T.page_lines(spark, sf_dir)
    return J.range_join(lines.select("page", "line_no"), _ranges(lines), ["page"], "line_no", "low", "high", "ord").select("page", "line_no", "ord", "high")


@query(RANGES + "SELECT page, line_no, max(ord) AS ord, max_by(high, ord) AS high FROM hit GROUP BY 1, 2")
def range_join_last(spark, sf_dir):
    lines = T.page_lines(spark, sf_dir)
    return J.range_join(lines.select("page", "line_no"), _ranges(lines), ["page"], "line_no", "low", "high", "ord", "last").select("page", "line_no", "ord", "high")


@query(""", o AS (SELECT *, max(CASE WHEN length(line) % 5 = 0 THEN line_no END) OVER (PARTITION BY page ORDER BY line_no) AS s FROM lin)
    SELECT o.page, o.line_no, CASE WHEN o.line_no <= o.s + 1 + length(l.line) % 7 THEN o.s END AS material
    FROM o LEFT JOIN lin l ON l.page = o.page AND l.line_no = o.s""")
def range_join_current(spark, sf_dir):
    lines = T.page_lines(spark, sf_dir)
    n = F.length("line")
    rows = lines.withColumns({"s": F.when(n % 5 == 0, F.col("line_no")), "e": F.when(n % 5 == 0, F.col("line_no") + 1 + n % 7)})
    return J.current_range(rows, ["page"], "line_no", "s", "e", "line_no", "material").select("page", "line_no", "material")


@query(""", v AS (SELECT page, line_no FROM lin WHERE length(line) % 3 = 1), q AS (SELECT page, line_no FROM lin WHERE length(line) % 3 = 0)
    SELECT v.page, v.line_no, CASE WHEN min(q.line_no) - v.line_no <= 8 THEN min(q.line_no) END AS following
    FROM v LEFT JOIN q ON q.page = v.page AND q.line_no > v.line_no GROUP BY v.page, v.line_no""")
def asof_next_question(spark, sf_dir):
    lines = T.page_lines(spark, sf_dir)
    v = lines.where(F.length("line") % 3 == 1).select("page", "line_no")
    q = lines.where(F.length("line") % 3 == 0).select("page", "line_no", F.col("line_no").alias("q"))
    return J.following(v, q, ["page"], "line_no", "q", 8)


@query(""", v AS (SELECT page, line_no FROM lin WHERE length(line) % 3 = 1), q AS (SELECT page, line_no FROM lin WHERE length(line) % 3 = 0)
    SELECT v.page, v.line_no, max(q.line_no) AS preceding FROM v LEFT JOIN q ON q.page = v.page AND q.line_no <= v.line_no GROUP BY 1, 2""")
def asof_last_question(spark, sf_dir):
    lines = T.page_lines(spark, sf_dir)
    v = lines.where(F.length("line") % 3 == 1).select("page", "line_no")
    q = lines.where(F.length("line") % 3 == 0).select("page", "line_no", F.col("line_no").alias("q"))
    return J.preceding(v, q, ["page"], "line_no", "q")


@query("""SELECT a.o_orderkey, coalesce(b.l_suppkey, c.l_suppkey) AS owner FROM orders a
    LEFT JOIN (SELECT l_orderkey, min_by(l_suppkey, k) AS l_suppkey FROM (SELECT l_orderkey, l_suppkey, l_linenumber * 1000000 + l_suppkey AS k FROM lineitem) GROUP BY 1) b ON b.l_orderkey = a.o_orderkey
    LEFT JOIN (SELECT s_suppkey * 3 AS k, s_suppkey AS l_suppkey FROM supplier) c ON c.k = a.o_orderkey""", prelude=False)
def key_or_position(spark, sf_dir):
    """The value by key (its first), else that by position."""
    o = T.read(spark, sf_dir, "orders", "o_orderkey").withColumn("place", F.col("o_orderkey"))
    by_key = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (-1 - F.col("l_linenumber") * 1_000_000 - F.col("l_suppkey")).alias("place"), F.col("l_suppkey").alias("owner"))
    by_key = by_key.groupBy("o_orderkey").agg(F.max_by("owner", "place").alias("owner")).withColumn("place", -1 - F.col("o_orderkey"))
    by_place = T.read(spark, sf_dir, "supplier").select(F.lit(None).cast("long").alias("o_orderkey"), (F.col("s_suppkey") * 3).alias("place"), F.col("s_suppkey").alias("owner"))
    out = J.by_key_or_position(o, by_key.unionByName(by_place), "o_orderkey", "place", "owner", "owner")
    return out.select("o_orderkey", "owner")


@query("""SELECT p.p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, s_name) AS answer
    FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey""", prelude=False)
def answer_fill(spark, sf_dir):
    q = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" ")).alias("answer"))
    a = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("answer"))
    return J.filled(q, a, "k", "answer").select(F.col("k").alias("p_partkey"), "answer")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = l_linenumber", prelude=False)
def composite_join(spark, sf_dir):
    line, s = T.read(spark, sf_dir, "lineitem"), T.read(spark, sf_dir, "supplier")
    return line.join(s, (s["s_suppkey"] == line["l_suppkey"]) & (s["s_nationkey"] == line["l_linenumber"]), "left").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT o_orderkey, c_name AS saved FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0", prelude=False)
def temp_id_mapping(spark, sf_dir):
    mapping = T.read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("temp_id"), F.col("c_name").alias("id"))
    return J.remapped(T.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("saved")), mapping, "saved")


@query("SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id) WHERE quality = 0 OR toxic = 1", prelude=False)
def labelled_documents(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents", "doc_id")
    return T.read(spark, sf_dir, "labels").where((F.col("quality") == 0) | (F.col("toxic") == 1)).join(docs, "doc_id").select("doc_id", "quality", "toxic")


@query("""SELECT p_partkey, CASE WHEN b IS NULL THEN 'missing' WHEN p_brand <> b AND p_type <> t THEN 'p_brand|p_type' WHEN p_brand <> b THEN 'p_brand' ELSE 'p_type' END AS failures
    FROM part LEFT JOIN (SELECT p_partkey + 1 AS k, p_brand AS b, p_type AS t FROM part WHERE p_size > 5) ON k = p_partkey
    WHERE b IS NULL OR p_brand <> b OR p_type <> t""", prelude=False)
def expected_actual(spark, sf_dir):
    p = T.read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    actual = p.where(F.col("p_size") > 5).select((F.col("p_partkey") + 1).alias("p_partkey"), "p_brand", "p_type")
    return J.checked(p, actual, "p_partkey", ["p_brand", "p_type"]).withColumn("failures", F.array_join("failures", "|"))


@query("""SELECT conv_id, string_agg(role, '|' ORDER BY first) AS roles, count(*) AS n FROM (
    SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", prelude=False)
def ordered_union(spark, sf_dir):
    """Distinct values in order of first sight."""
    c = T.read(spark, sf_dir, "conversations", "conv_id", "turn", "role").where("role is not null")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    pairs = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "role"))).alias("p"))
    roles = A.ordered_union(F.transform("p", lambda x: x["role"]), F.array(F.lit(None).cast("string")))
    return pairs.select("conv_id", F.array_join(A.texts(roles), "|").alias("roles"), F.size(A.texts(roles)).cast("long").alias("n"))


@query("""SELECT p_type, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2""", prelude=False)
def signature_dedupe(spark, sf_dir):
    """The first of each signature stays."""
    p = T.read(spark, sf_dir, "part").withColumn("sig", F.to_json(F.struct(X.signature(F.col("p_type")), X.signature(F.col("p_brand")))))
    return p.groupBy("sig").agg(F.min(F.struct("p_partkey", "p_type", "p_brand")).alias("r")).select("r.p_type", "r.p_brand", "r.p_partkey")


@query("""SELECT page, line_no, row_number() OVER (PARTITION BY page, length(line) ORDER BY line_no) > 1 AS is_repeat FROM lin""")
def duplicate_indexes(spark, sf_dir):
    rows = T.page_lines(spark, sf_dir).withColumn("index", F.length("line"))
    return W.repeats(rows, ["page"], "index", ["line_no"]).select("page", "line_no", "is_repeat")


@query("""SELECT p_partkey, p_size, CASE WHEN p_size > 20 THEN p_size + 1 ELSE p_size END AS shifted,
    CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS image_order FROM part""", prelude=False)
def shift_and_renumber(spark, sf_dir):
    p = T.read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").withColumn("shifted", F.col("p_size"))
    return W.numbered(W.shifted(p, "shifted", 20), ["p_brand"], ["p_size", "p_partkey"], "image_order").select("p_partkey", "p_size", "shifted", "image_order")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) / 20) AS INTEGER) AS batch_no FROM lineitem""", prelude=False)
def page_batches(spark, sf_dir):
    line = T.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return K.batches(line, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "batch_no")


@query("""SELECT p_brand, count(*) AS n_questions, CAST(sum(p_size) AS BIGINT) AS index_sum FROM part GROUP BY 1""", prelude=False)
def nested_export(spark, sf_dir):
    p = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("bank_id"), "p_partkey", "p_size")
    banks = p.select("bank_id").distinct()
    out = K.nested_export(banks, p.where("p_size > 45").select("bank_id", "p_partkey"), p)
    index_sum = F.aggregate("questions", F.lit(0).cast("long"), lambda a, q: a + q["p_size"])
    return out.select(F.col("bank_id").alias("p_brand"), F.size("questions").cast("long").alias("n_questions"), index_sum.alias("index_sum"))


@query("""SELECT count(*) FILTER (p_size > 10 AND p_partkey % 7 = 0) AS changed, count(*) FILTER (NOT (p_size > 10) AND p_partkey % 7 = 0) AS skipped FROM part""", prelude=False)
def batch_delete_outcome(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    return M.batch_outcome(p, p.where("p_partkey % 7 = 0"), "p_partkey", F.col("p_size") > 10)


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY new DESC, o DESC) AS n FROM (
    SELECT o_custkey AS k, o_orderstatus AS v, o_orderkey AS o, o_orderkey % 4 = 0 AS new FROM orders)) WHERE n = 1""", prelude=False)
def upsert(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("o"))
    return M.upserted(o.where("o % 4 <> 0"), o.where("o % 4 = 0"), ["k"], "o").select("k", "v")


@query("""SELECT id, is_mastered OR question_id = 5 AS is_mastered, removed_from_wrong OR NOT is_correct AS removed_from_wrong FROM rec WHERE NOT (question_id = 7 AND NOT is_correct)""")
def record_updates(spark, sf_dir):
    r = T.records(spark, sf_dir)
    r = M.updated(r, F.col("question_id") == 5, is_mastered=F.lit(True))
    r = M.updated(r, ~F.col("is_correct"), removed_from_wrong=F.lit(True))
    return M.deleted(r, (F.col("question_id") == 7) & ~F.col("is_correct")).select("id", "is_mastered", "removed_from_wrong")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 5 <> 0
    UNION ALL SELECT DISTINCT o_custkey, o_custkey AS o_orderkey FROM orders WHERE o_custkey % 5 = 0)""", prelude=False)
def replace_selection(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    owners = o.where("o_custkey % 5 = 0")
    return M.replaced_set(o, "o_custkey", owners, owners.select("o_custkey", F.col("o_custkey").alias("o_orderkey")))


EVENTS = """CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'retry' END"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {EVENTS} AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    m(ev, f, t) AS (VALUES ('start', 'pending', 'processing'), ('finish', 'processing', 'done'), ('fail', 'pending', 'failed'), ('fail', 'processing', 'failed'),
        ('retry', 'failed', 'pending'), ('retry', 'paused', 'pending'), ('pause', 'pending', 'paused'), ('pause', 'processing', 'paused')),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, 0 AS refused FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL SELECT s.user_id, e.n, coalesce(m.t, s.status), s.refused + CASE WHEN m.t IS NULL THEN 1 ELSE 0 END
        FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1 LEFT JOIN m ON m.ev = e.ev AND m.f = s.status)
    SELECT user_id, max_by(status, n) AS status, max_by(refused, n) AS refused FROM s GROUP BY 1""", prelude=False)
def task_transitions(spark, sf_dir):
    e = F.col("event_type")
    event = F.when(e == "click", "start").when(e == "view", "pause").when(e == "purchase", "finish").when(e == "error", "fail").otherwise("retry")
    return M.final_states(T.read(spark, sf_dir, "events").select("user_id", "event_id", event.alias("event")), "user_id", "event_id")


VERSIONS = """WITH RECURSIVE p AS (
        SELECT p_brand AS task, p_partkey AS arrival, CAST(floor(p_partkey / 300) AS INTEGER) AS batch, p_size % 12 AS index_num,
               if(p_size % 9 = 0, NULL, p_type || p_size % 5) AS sig, CAST(floor(p_retailprice) AS INTEGER) % 20 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k
        FROM part),
    r AS (
        SELECT task, arrival, batch, k, 0 AS question, 'inserted' AS action, [{'sig': sig, 'idx': index_num, 'score': score}] AS qs,
               [{'sig': sig, 'q': 1, 'score': score}] AS sigs, [{'idx': index_num, 'q': 1}] AS idxs
        FROM p WHERE k = 1
        UNION ALL
        SELECT task, arrival, batch, k, CAST(n - 1 AS INTEGER), action,
               CASE action WHEN 'inserted' THEN list_append(qs, {'sig': sig, 'idx': index_num, 'score': score})
                   WHEN 'replaced' THEN list_concat(qs[1:n - 1], [{'sig': sig, 'idx': index_num, 'score': score}], qs[n + 1:]) ELSE qs END,
               if(action = 'inserted', list_append(sigs, {'sig': sig, 'q': n, 'score': score}), sigs),
               if(action = 'removed', idxs, list_append(idxs, {'idx': index_num, 'q': n}))
        FROM (
            SELECT *, coalesce(s.q, i.q, len(qs) + 1)::INTEGER AS n,
                   CASE WHEN s IS NOT NULL THEN if(score > s.score, 'replaced', 'removed') WHEN i IS NOT NULL THEN if(score > qs[i.q].score + 1, 'replaced', 'removed') ELSE 'inserted' END AS action
            FROM (
                SELECT *, list_filter(sigs, lambda x: x.sig = v.sig)[-1] AS s, list_filter(idxs, lambda x: x.idx = v.index_num)[-1] AS i
                FROM (
                    SELECT p.*, qs, if(p.batch = r.batch, sigs, list_transform(qs, lambda x, j: {'sig': x.sig, 'q': j::INTEGER, 'score': x.score})) AS sigs,
                           if(p.batch = r.batch, idxs, list_transform(qs, lambda x, j: {'idx': x.idx, 'q': j::INTEGER})) AS idxs
                    FROM r JOIN p ON p.task = r.task AND p.k = r.k + 1) v)))
"""


def _settled(spark, sf_dir):
    n = F.col("p_size")
    p = T.read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("task"), F.col("p_partkey").alias("arrival"), F.floor(F.col("p_partkey") / 300).cast("int").alias("batch"), (n % 12).alias("index_num"),
        F.when(n % 9 != 0, F.concat("p_type", (n % 5).cast("string"))).alias("sig"), (F.floor("p_retailprice").cast("int") % 20).alias("score"),
    )
    return N.settled(p, "task", "batch", "arrival", "index_num", "sig", "score")


@query(VERSIONS + "SELECT task, arrival, question, action FROM r", prelude=False)
def version_resolution(spark, sf_dir):
    """Arriving versions settled by signature, then by index, in order of arrival."""
    return _settled(spark, sf_dir).select("task", "arrival", "question", "action")


@query(VERSIONS + """SELECT task, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'replaced') AS replaced, count(*) FILTER (action = 'removed') AS removed,
    count(*) FILTER (action <> 'inserted') AS detected, count(*) FILTER (action <> 'removed') AS saved, CAST(sum(last) AS BIGINT) AS last_arrivals
    FROM r JOIN (SELECT task, question, max(arrival) FILTER (action <> 'removed') AS l FROM r GROUP BY 1, 2) m USING (task, question),
    LATERAL (SELECT if(action = 'inserted', l, 0) AS last) GROUP BY 1""", prelude=False)
def version_counters(spark, sf_dir):
    """Counters of the same, and which row each question ends with (their arrivals' sum)."""
    decided = _settled(spark, sf_dir)
    last = N.final_versions(decided, "task", "batch", "arrival").groupBy("task").agg(F.sum("arrival").alias("last_arrivals"))
    return N.version_counts(decided, "task").join(last, "task")


@query("SELECT qid, bank_id, CASE WHEN bank_id = 'Brand#7' THEN 1 WHEN bank_id = 'Brand#3' THEN 2 END AS place FROM que ORDER BY place NULLS LAST, qid LIMIT 150")
def given_order(spark, sf_dir):
    """The first page of all questions, those of the given banks first."""
    q = T.questions(spark, sf_dir)
    order = P.in_given_order(q, "bank_id", ["Brand#7", "Brand#3"], ["qid"])
    return q.orderBy(*order).limit(150).select("qid", "bank_id", F.nullif(F.array_position(F.lit(["Brand#7", "Brand#3"]), F.col("bank_id")), F.lit(0)).cast("int").alias("place"))
