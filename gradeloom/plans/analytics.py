"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import stats as S
from gradeloom.plans.registry import AS_OF, query
from gradeloom.sources import tables as T


def now():
    return F.lit(AS_OF).cast("timestamp")


@query(f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS answer_count, count(DISTINCT user_id) AS user_count,
    round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS accuracy_rate
    FROM rec WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1""")
def trend_daily(spark, sf_dir):
    return S.trend(T.records(spark, sf_dir), now())


@query(f"""SELECT
    (SELECT count(*) FROM orders) AS total_users,
    (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS new_users_today,
    (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS new_users_week,
    (SELECT count(DISTINCT p_brand) FROM part) AS total_banks,
    (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand <> 'Brand#2') AS published_banks,
    (SELECT count(*) FROM part) AS total_questions,
    (SELECT count(*) FROM part WHERE p_size > 10) AS published_questions,
    count(DISTINCT user_id) FILTER (created_at >= TIMESTAMP '2024-01-30') AS active_users_today,
    count(DISTINCT user_id) FILTER (created_at >= TIMESTAMP '2024-01-29') AS active_users_week,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-30') AS total_answered_today,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS total_answered_week,
    count(*) AS total_answered_all,
    round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS avg_accuracy_rate
    FROM rec""")
def overview(spark, sf_dir):
    users = T.read(spark, sf_dir, "orders", "o_orderdate").select(F.when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"), now()).otherwise(F.col("o_orderdate")).alias("created_at"))
    part = T.read(spark, sf_dir, "part", "p_brand", "p_size")
    banks = part.select("p_brand").distinct().select(F.when(F.col("p_brand") != "Brand#2", F.lit("published")).otherwise(F.lit("draft")).alias("status"))
    questions = part.select(F.when(F.col("p_size") > 10, F.lit("published")).otherwise(F.lit("draft")).alias("status"))
    return S.overview(users, banks, questions, T.records(spark, sf_dir), F.lit("2024-01-30 18:00:00").cast("timestamp"))


@query(f"""SELECT user_id, strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count
    FROM rec WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1, 2""")
def calendar(spark, sf_dir):
    return S.calendar(T.records(spark, sf_dir), now())


@query(f""", d AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM rec WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY),
    i AS (SELECT *, CAST(day + CAST(row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS INTEGER) AS DATE) AS island FROM d),
    r AS (SELECT user_id, island, max(day) AS last, count(*) AS n FROM i GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS k FROM r)
    SELECT user_id, CASE WHEN last >= DATE '2024-01-30' THEN n ELSE 0 END AS streak_days, strftime(last, '%Y-%m-%d') AS last_active_date
    FROM b WHERE k = 1""")
def streak(spark, sf_dir):
    return S.streak(T.records(spark, sf_dir), now())


@query(""", g AS (SELECT user_id, bank_id, count(*) AS answered, count(*) FILTER (is_correct) AS correct FROM both_ GROUP BY 1, 2 HAVING count(*) >= 5),
    a AS (SELECT *, round(100.0 * correct / answered, 1) AS accuracy_rate FROM g)
    SELECT user_id, bank_id, answered, accuracy_rate, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy_rate, bank_id NULLS FIRST) AS rank FROM a) WHERE rank <= 5""")
def weakness(spark, sf_dir):
    return S.weakness(T.records(spark, sf_dir), T.questions(spark, sf_dir)).drop("correct")


@query("""SELECT user_id, bank_id, count(*) FILTER (NOT is_mastered) AS wrong_count, count(*) FILTER (is_mastered) AS mastered_count
    FROM both_ WHERE NOT is_correct GROUP BY 1, 2""")
def wrong_stats(spark, sf_dir):
    return S.wrong_stats(T.records(spark, sf_dir), T.questions(spark, sf_dir))


@query("""SELECT user_id, count(*) FILTER (NOT is_mastered) AS total_wrong, count(*) FILTER (is_mastered) AS mastered_count
    FROM rec WHERE NOT is_correct GROUP BY 1""")
def wrong_totals(spark, sf_dir):
    return S.wrong_totals(T.records(spark, sf_dir))


@query("""SELECT user_id, coalesce(subject, '') AS subject, count(*) AS answered, count(*) FILTER (is_correct) AS correct,
    round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS accuracy_rate FROM both_ GROUP BY 1, 2""")
def by_subject(spark, sf_dir):
    return S.by_subject(T.records(spark, sf_dir), T.questions(spark, sf_dir))


@query("""SELECT user_id, count(*) AS total_answered, count(*) FILTER (is_correct) AS correct_count,
    count(*) FILTER (NOT is_correct AND NOT removed_from_wrong) AS wrong_count,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-30') AS today_answered,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS week_answered,
    round(CAST(count(*) FILTER (is_correct) AS DOUBLE) / count(*), 4) AS accuracy_rate FROM rec GROUP BY 1""")
def user_stats(spark, sf_dir):
    return S.user_stats(T.records(spark, sf_dir), F.lit("2024-01-30 18:00:00").cast("timestamp"))


@query("""SELECT user_id, count(*) AS total_answered, count(*) FILTER (is_correct) AS correct_count,
    count(*) FILTER (NOT is_correct AND NOT is_mastered) AS wrong_count,
    round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS accuracy_rate FROM rec GROUP BY 1""")
def admin_user_stats(spark, sf_dir):
    return S.admin_user_stats(T.records(spark, sf_dir))


@query("""SELECT question_id, count(*) AS answer_count, round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS correct_rate
    FROM rec GROUP BY 1""")
def question_stats(spark, sf_dir):
    return S.question_stats(T.records(spark, sf_dir))


@query("""SELECT a.*, c_name, round(100.0 * correct_count / answer_count, 1) AS accuracy_rate FROM (
        SELECT user_id, count(*) AS answer_count, count(*) FILTER (is_correct) AS correct_count, max(created_at) AS last_active_at
        FROM rec WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 20) a
    LEFT JOIN customer ON c_custkey = user_id""")
def active_users(spark, sf_dir):
    users = T.read(spark, sf_dir, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "user_id")
    return S.active_users(T.records(spark, sf_dir), users, "week", now(), page=2)


@query(f"SELECT count(*) AS answers, count(DISTINCT user_id) AS users FROM rec WHERE created_at >= TIMESTAMP '2024-01-24'")
def active_since(spark, sf_dir):
    return S.since(T.records(spark, sf_dir), F.lit("2024-01-24").cast("timestamp"))


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS questions, count(l_orderkey) AS answers,
    count(*) FILTER (l_returnflag <> 'R') AS correct, count(DISTINCT l_suppkey) AS users,
    CASE WHEN count(l_orderkey) > 0 THEN round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(l_orderkey), 1) ELSE 0.0 END AS accuracy_rate
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""", prelude=False)
def bank_rollup(spark, sf_dir):
    banks = T.read(spark, sf_dir, "customer", "c_custkey")
    questions = T.read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    records = T.read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", (F.col("l_returnflag") != "R").alias("is_correct"))
    return S.bank_rollup(banks, questions, records, "c_custkey", "o_orderkey", "l_suppkey")


@query(""", s AS (SELECT question_id, count(*) AS answer_count, round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS correct_rate FROM rec GROUP BY 1)
    SELECT qid, bank_id, coalesce(answer_count, 0) AS answer_count, coalesce(correct_rate, 0) AS correct_rate
    FROM que LEFT JOIN s ON qid = question_id ORDER BY 3 DESC, 1 LIMIT 20""")
def hot_questions(spark, sf_dir):
    questions = T.questions(spark, sf_dir)
    out = S.hot_questions(questions, S.question_stats(T.records(spark, sf_dir)), questions.select("bank_id").distinct())
    return out.select("qid", "bank_id", "answer_count", "correct_rate")


@query(""", s AS (SELECT question_id, round(100.0 * count(*) FILTER (is_correct) / count(*), 1) AS correct_rate FROM rec GROUP BY 1)
    SELECT qid, correct_rate FROM que JOIN s ON qid = question_id ORDER BY 2, 1 LIMIT 100""")
def most_wrong_questions(spark, sf_dir):
    """More than the limit is asked for; 100 is the most."""
    questions = T.questions(spark, sf_dir)
    stats = S.question_stats(T.records(spark, sf_dir))
    answered = questions.join(stats.select(F.col("question_id").alias("qid")), "qid", "left_semi")
    return S.hot_questions(answered, stats, questions.select("bank_id").distinct(), "wrong_rate", 500).select("qid", "correct_rate")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS published,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS needs_review, count(*) FILTER (o_orderstatus <> 'F') AS draft FROM orders""", prelude=False)
def review_stats(spark, sf_dir):
    return S.review_stats(_reviewed(spark, sf_dir))


def _reviewed(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("published")).otherwise(F.lit("draft")).alias("status")
    return T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bank_id"), status, (F.col("o_orderpriority") == "1-URGENT").alias("needs_review"))


@query("""SELECT o_custkey AS bank_id, count(*) FILTER (o_orderstatus = 'F') AS published_count, count(*) AS all_count
    FROM orders GROUP BY 1""", prelude=False)
def bank_totals(spark, sf_dir):
    return S.bank_totals(_reviewed(spark, sf_dir))


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS n
    FROM supplier""", prelude=False)
def material_counts(spark, sf_dir):
    materials = T.read(spark, sf_dir, "supplier", "s_suppkey")
    questions = T.read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").where(F.col("l_quantity") > 45).select(F.col("l_suppkey").alias("s_suppkey"))
    return S.counts_of(materials, questions, "s_suppkey")


@query("""SELECT p_type AS subject, CAST(sum(n) AS BIGINT) AS total, min_by(p_brand, p_brand) AS first_bank
    FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1""", prelude=False)
def subject_rollup(spark, sf_dir):
    banks = T.read(spark, sf_dir, "part", "p_type", "p_brand").groupBy(F.col("p_type").alias("subject"), F.col("p_brand").alias("bank_id")).agg(F.count(F.lit(1)).alias("total_count"))
    return S.subject_rollup(banks, "bank_id")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed,
    round(avg(o_custkey) FILTER (o_orderstatus = 'F'), 2) AS avg_questions, round(avg(o_orderkey) FILTER (o_orderstatus = 'F'), 2) AS avg_seconds
    FROM orders""", prelude=False)
def service_stats(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "P", F.lit("failed")).otherwise(F.lit("open"))
    return S.service_stats(T.read(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_custkey").alias("questions"), F.col("o_orderkey").alias("seconds")))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END)
    WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY 1""", prelude=False)
def outcome_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("success")).when(F.col("o_orderstatus") == "O", F.lit("failed")).otherwise(F.lit("skipped"))
    return S.status_of(T.read(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), "o_custkey", "status")
