"""Queries over callbacks as they arrive."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.plans.registry import query
from gradeloom.sources import tables as T
from gradeloom.streaming import task_state as S


def _messages(spark, sf_dir):
    """A user's events as the callbacks of a task; a seventh of them are sent twice."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.expr("""CASE event_type WHEN 'click' THEN 'materials' WHEN 'signup' THEN 'resume' WHEN 'error' THEN if(k % 4 = 0, 'pause', 'questions')
        WHEN 'purchase' THEN if(k % 3 = 0, 'finish', 'questions') ELSE 'questions' END""")
    e = T.read(spark, sf_dir, "events").withColumn("k", k)
    own = e.select(
        F.col("user_id").alias("task"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("seq"),
        kind.alias("kind"),
        F.concat(F.lit("t"), (F.col("k") % 5).cast("string")).alias("temp_id"),
        F.col("event_id").alias("material_id"),
        F.when(kind == "finish", F.col("k") % 2 * 10).otherwise(1 + F.col("k") % 4).alias("amount"),
        F.when(F.col("k") % 2 == 0, F.lit(40)).otherwise(F.lit(0)).cast("long").alias("announced"),
        "k",
    )
    times = F.when(F.col("k") % 7 == 0, 2).otherwise(1)
    return own.withColumn("_again", F.explode(F.sequence(F.lit(1), times))).drop("k", "_again")


@query(
    r"""WITH RECURSIVE e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
    m AS (
        SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, 't' || (k % 5) AS temp_id, event_id AS material_id, k,
               CASE event_type WHEN 'click' THEN 'materials' WHEN 'signup' THEN 'resume' WHEN 'error' THEN if(k % 4 = 0, 'pause', 'questions')
                   WHEN 'purchase' THEN if(k % 3 = 0, 'finish', 'questions') ELSE 'questions' END AS kind,
               if(k % 2 = 0, 40, 0) AS announced
        FROM e),
    a AS (SELECT *, if(kind = 'finish', k % 2 * 10, 1 + k % 4) AS amount FROM m),
    r AS (
        SELECT DISTINCT task, 0::BIGINT AS applied, 'pending' AS status, 0 AS progress, 0::BIGINT AS done, 0::BIGINT AS total, 0::BIGINT AS linked,
               0::BIGINT AS material_sum, 0::BIGINT AS ignored, MAP {}::MAP(VARCHAR, BIGINT) AS known FROM a
        UNION ALL
        SELECT r.task, r.applied + 1,
               CASE WHEN kind = 'pause' THEN if(status IN ('pending', 'processing'), 'paused', status)
                    WHEN kind = 'resume' THEN if(status = 'paused', 'processing', status)
                    WHEN status = 'paused' OR kind = 'materials' THEN status
                    WHEN kind = 'questions' THEN 'processing' WHEN amount + done > 0 THEN 'done' ELSE 'failed' END,
               CASE WHEN status = 'paused' OR kind NOT IN ('questions', 'finish') THEN progress WHEN kind = 'finish' THEN 100
                    WHEN announced > 0 THEN least(95, greatest(15, CAST(floor((done + amount) * 90.0 / announced + 0.5) AS INTEGER))) ELSE progress END,
               CASE WHEN status = 'paused' OR kind NOT IN ('questions', 'finish') THEN done WHEN kind = 'questions' THEN done + amount WHEN done > 0 THEN done ELSE amount END,
               CASE WHEN status = 'paused' OR kind NOT IN ('questions', 'finish') THEN total WHEN kind = 'finish' THEN if(amount > 0, amount, done)
                    WHEN announced > 0 THEN announced ELSE total END,
               linked + if(status <> 'paused' AND kind = 'questions' AND known[temp_id] IS NOT NULL, amount, 0),
               material_sum + if(status <> 'paused' AND kind = 'questions', coalesce(known[temp_id], 0), 0),
               ignored + if(status = 'paused' AND kind NOT IN ('pause', 'resume'), 1, 0),
               CASE WHEN status = 'paused' THEN known WHEN kind = 'materials' THEN map_concat(known, MAP {temp_id: a.material_id})
                    WHEN kind = 'finish' THEN MAP {}::MAP(VARCHAR, BIGINT) ELSE known END
        FROM r JOIN a ON a.task = r.task AND a.seq = r.applied),
    s AS (SELECT user_id AS task, count(*) AS n, count(*) FILTER (k % 7 = 0) AS repeats FROM e GROUP BY 1)
    SELECT r.task, applied, status, progress, done, total, CAST(cardinality(known) AS BIGINT) AS materials, linked, material_sum, ignored, repeats, CAST(0 AS BIGINT) AS waiting
    FROM r JOIN s ON s.task = r.task AND s.n = r.applied""",
    prelude=False,
)
def callback_states(spark, sf_dir):
    return S.replayed(_messages(spark, sf_dir))
