"""Statistics over answer records (user_id, question_id, created_at, is_correct, is_mastered,
removed_from_wrong), questions and banks.  Each is one aggregation of all users or banks at
once, with partial aggregation before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.dates import days_before, iso_date, period_start, start_of_day, start_of_week
from gradeloom.functions.numeric import count_if, percent, ratio

COUNT = F.count


def n_rows() -> Column:
    return F.count(F.lit(1))


def trend(records: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """A row a day: answers, users and accuracy."""
    recent = records.where(F.col("created_at") >= days_before(as_of, days))
    out = recent.groupBy(iso_date(F.col("created_at")).alias("date")).agg(n_rows().alias("answer_count"), F.countDistinct("user_id").alias("user_count"), count_if(F.col("is_correct")).alias("correct"))
    return out.select("date", "answer_count", "user_count", percent(F.col("correct"), F.col("answer_count")).alias("accuracy_rate"))


def overview(users: DataFrame, banks: DataFrame, questions: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """One row of thirteen figures: one pass over each table, joined as single rows."""
    today, week = start_of_day(as_of), start_of_week(as_of)
    at = F.col("created_at")
    u = users.agg(n_rows().alias("total_users"), count_if(at >= today).alias("new_users_today"), count_if(at >= week).alias("new_users_week"))
    b = banks.agg(n_rows().alias("total_banks"), count_if(F.col("status") == "published").alias("published_banks"))
    q = questions.agg(n_rows().alias("total_questions"), count_if(F.col("status") == "published").alias("published_questions"))
    r = records.agg(
        F.countDistinct(F.when(at >= today, F.col("user_id"))).alias("active_users_today"),
        F.countDistinct(F.when(at >= week, F.col("user_id"))).alias("active_users_week"),
        count_if(at >= today).alias("total_answered_today"),
        count_if(at >= week).alias("total_answered_week"),
        n_rows().alias("total_answered_all"),
        count_if(F.col("is_correct")).alias("correct_all"),
    )
    one = r.withColumn("avg_accuracy_rate", percent(F.col("correct_all"), F.col("total_answered_all"))).drop("correct_all")
    for other in (u, b, q):  # one row each
        one = one.withColumn("_k", F.lit(1)).join(other.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one


def since(records: DataFrame, start: Column) -> DataFrame:
    recent = records.where(F.col("created_at") >= start)
    return recent.agg(n_rows().alias("answers"), F.countDistinct("user_id").alias("users"))


def user_stats(records: DataFrame, as_of: Column) -> DataFrame:
    """A row a user.  Wrong counts those not taken off the wrong list."""
    today, week, at = start_of_day(as_of), start_of_week(as_of), F.col("created_at")
    out = records.groupBy("user_id").agg(
        n_rows().alias("total_answered"),
        count_if(F.col("is_correct")).alias("correct_count"),
        count_if(~F.col("is_correct") & ~F.col("removed_from_wrong")).alias("wrong_count"),
        count_if(at >= today).alias("today_answered"),
        count_if(at >= week).alias("week_answered"),
    )
    return out.withColumn("accuracy_rate", ratio(F.col("correct_count"), F.col("total_answered")))


def admin_user_stats(records: DataFrame) -> DataFrame:
    """A row a user, as the administration counts: wrong are those not mastered."""
    out = records.groupBy("user_id").agg(n_rows().alias("total_answered"), count_if(F.col("is_correct")).alias("correct_count"), count_if(~F.col("is_correct") & ~F.col("is_mastered")).alias("wrong_count"))
    return out.withColumn("accuracy_rate", percent(F.col("correct_count"), F.col("total_answered")))


def calendar(records: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    recent = records.where(F.col("created_at") >= days_before(as_of, days))
    return recent.groupBy("user_id", iso_date(F.col("created_at")).alias("date")).agg(n_rows().alias("count"))


def streak(records: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Consecutive days up to today, or else yesterday; else 0 and the last active day."""
    active = records.where(F.col("created_at") >= days_before(as_of, days)).select("user_id", F.to_date("created_at").alias("day")).distinct()
    newest = Window.partitionBy("user_id").orderBy(F.desc("day"))
    island = active.withColumn("island", F.date_add("day", F.row_number().over(newest)))
    runs = island.groupBy("user_id", "island").agg(F.max("day").alias("last"), n_rows().alias("n"))
    out = runs.groupBy("user_id").agg(F.max_by("n", "last").alias("n"), F.max("last").alias("last"))
    current = F.col("last") >= F.date_sub(F.to_date(as_of), 1)
    return out.select("user_id", F.when(current, F.col("n")).otherwise(F.lit(0)).cast("long").alias("streak_days"), F.date_format("last", "yyyy-MM-dd").alias("last_active_date"))


def by_bank(records: DataFrame, questions: DataFrame) -> DataFrame:
    """Records beside their question's bank and subject; either may be missing."""
    return records.join(questions.select("qid", "bank_id", "subject"), F.col("question_id") == F.col("qid"), "left")


def by_subject(records: DataFrame, questions: DataFrame) -> DataFrame:
    out = by_bank(records, questions).groupBy("user_id", F.coalesce("subject", F.lit("")).alias("subject")).agg(n_rows().alias("answered"), count_if(F.col("is_correct")).alias("correct"))
    return out.withColumn("accuracy_rate", percent(F.col("correct"), F.col("answered")))


def weakness(records: DataFrame, questions: DataFrame, least: int = 5, top: int = 5) -> DataFrame:
    """Of a user's banks with enough answers those with the lowest accuracy."""
    out = by_bank(records, questions).groupBy("user_id", "bank_id").agg(n_rows().alias("answered"), count_if(F.col("is_correct")).alias("correct"))
    out = out.where(F.col("answered") >= least).withColumn("accuracy_rate", percent(F.col("correct"), F.col("answered")))
    rank = Window.partitionBy("user_id").orderBy("accuracy_rate", F.col("bank_id").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def wrong_stats(records: DataFrame, questions: DataFrame) -> DataFrame:
    """A row for each user and bank of wrong and of since mastered answers."""
    wrong = by_bank(records, questions).where(~F.col("is_correct"))
    return wrong.groupBy("user_id", "bank_id").agg(count_if(~F.col("is_mastered")).alias("wrong_count"), count_if(F.col("is_mastered")).alias("mastered_count"))


def wrong_totals(records: DataFrame) -> DataFrame:
    wrong = records.where(~F.col("is_correct"))
    return wrong.groupBy("user_id").agg(count_if(~F.col("is_mastered")).alias("total_wrong"), count_if(F.col("is_mastered")).alias("mastered_count"))


def question_stats(records: DataFrame) -> DataFrame:
    out = records.groupBy("question_id").agg(n_rows().alias("answer_count"), count_if(F.col("is_correct")).alias("correct"))
    return out.select("question_id", "answer_count", percent(F.col("correct"), F.col("answer_count")).alias("correct_rate"))


def active_users(records: DataFrame, users: DataFrame, period: str, as_of: Column, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the leaderboard; total is the page's length, as shown."""
    recent = records.where(F.col("created_at") >= period_start(period, as_of))
    out = recent.groupBy("user_id").agg(n_rows().alias("answer_count"), count_if(F.col("is_correct")).alias("correct_count"), F.max("created_at").alias("last_active_at"))
    top = out.orderBy(F.desc("answer_count"), "user_id").offset((page - 1) * size).limit(size)
    return top.join(users, "user_id", "left").withColumn("accuracy_rate", percent(F.col("correct_count"), F.col("answer_count")))


def bank_rollup(banks: DataFrame, questions: DataFrame, records: DataFrame, key: str, question: str, user: str) -> DataFrame:
    """A row a bank, those without questions or records too: questions, answers, users and
    accuracy.  Answers are counted by question first, so banks don't fan out."""
    per = records.groupBy(question).agg(n_rows().alias("n"), count_if(F.col("is_correct")).alias("c"))
    who = questions.select(key, question).join(records.select(question, user), question).select(key, user).distinct().groupBy(key).agg(n_rows().alias("users"))
    own = questions.join(per, question, "left").groupBy(key).agg(n_rows().alias("questions"), F.sum(F.coalesce("n", F.lit(0))).alias("answers"), F.sum(F.coalesce("c", F.lit(0))).alias("correct"))
    out = banks.join(own, key, "left").join(who, key, "left").na.fill(0, ["questions", "answers", "correct", "users"])
    return out.withColumn("accuracy_rate", percent(F.col("correct"), F.col("answers")))


def hot_questions(questions: DataFrame, stats: DataFrame, banks: DataFrame, sort: str = "answer_count", limit: int = 20) -> DataFrame:
    """The most answered, or those most often wrong; at most 100."""
    both = questions.join(stats, F.col("qid") == F.col("question_id"), "left").na.fill(0, ["answer_count"]).na.fill(0.0, ["correct_rate"])
    order = F.asc("correct_rate") if sort == "wrong_rate" else F.desc("answer_count")
    return both.orderBy(order, "qid").limit(min(limit, 100)).join(banks, "bank_id", "left")


def review_stats(questions: DataFrame) -> DataFrame:
    status = F.col("status")
    return questions.agg(n_rows().alias("total"), count_if(status == "published").alias("published"), count_if(F.col("needs_review")).alias("needs_review"), count_if(status == "draft").alias("draft"))


def bank_totals(questions: DataFrame) -> DataFrame:
    """Both ways of counting a bank's questions: published ones, and all after a parse."""
    return questions.groupBy("bank_id").agg(count_if(F.col("status") == "published").alias("published_count"), n_rows().alias("all_count"))


def counts_of(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Each parent with its number of children, 0 if it has none."""
    own = children.groupBy(key).agg(n_rows().alias(name))
    return parents.join(own, key, "left").na.fill(0, [name])


def service_stats(runs: DataFrame) -> DataFrame:
    """Of a run log (status, questions, seconds): counts and averages, 0 of nothing."""
    done = F.col("status") == "done"
    out = runs.agg(n_rows().alias("total"), count_if(done).alias("done"), count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(done, F.col("questions"))).alias("q"), F.sum(F.when(done, F.col("seconds"))).alias("s"))
    average = lambda c: F.when(F.col("done") > 0, F.round(F.col(c) / F.col("done"), 2)).otherwise(F.lit(0.0))
    return out.select("total", "done", "failed", average("q").alias("avg_questions"), average("s").alias("avg_seconds"))


def subject_rollup(banks: DataFrame, order: str) -> DataFrame:
    """A subject's questions, and its first bank."""
    return banks.groupBy("subject").agg(F.sum("total_count").alias("total"), F.min_by("bank_id", order).alias("first_bank"))


def status_of(outcomes: DataFrame, key: str, status: str) -> DataFrame:
    """One status for many: all the same, or partial where some succeeded, or else failed."""
    found = F.collect_set(status)  # of four values
    own = outcomes.groupBy(key).agg(found.alias("found"))
    only = F.element_at("found", 1)
    partial = F.array_contains("found", "success") | F.array_contains("found", "partial")
    return own.select(key, F.when(F.size("found") == 1, only).when(partial, F.lit("partial")).otherwise(F.lit("failed")).alias("status"))
