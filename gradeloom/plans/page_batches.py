"""Documents as pages of papers, 23 a paper, in batches of five."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import page_batches as B
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T

MARK = r"^\d{3}、 "


@query(
    """WITH p AS (
        SELECT CAST(floor(doc_id / 23) AS BIGINT) AS doc, CAST(doc_id % 23 AS INTEGER) AS page, doc_id, coalesce(text, '') AS body, (doc_id % 900 + 100) || '、 ' AS mark FROM documents),
    t AS (
        SELECT *, CASE doc_id % 5 WHEN 0 THEN body || chr(10) || mark || body WHEN 1 THEN mark || body ELSE body END
               || if(doc_id % 19 = 7, chr(10) || '参考答案', '') AS text,
               CASE doc_id % 5 WHEN 0 THEN length(body) + 2 WHEN 1 THEN 1 ELSE 0 END AS cut
        FROM p),
    e AS (SELECT doc, max(page) + 1 AS total FROM t GROUP BY 1),
    s AS (SELECT doc, max(page) AS start FROM t JOIN e USING (doc) WHERE contains(text, '参考答案') AND page > greatest(total - 20, -1) GROUP BY 1),
    c AS (SELECT t.*, CAST(floor(page / 5) AS INTEGER) AS batch FROM t LEFT JOIN s USING (doc) WHERE start IS NULL OR start = 0 OR page < start),
    o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc, batch ORDER BY page) - length(text) - 1 AS before FROM c),
    w AS (SELECT doc, batch, string_agg(text, chr(10) ORDER BY page) AS text, coalesce(min(before + cut) FILTER (cut > 0), 0) AS pos FROM o GROUP BY 1, 2),
    b AS (SELECT *, coalesce(max(if(pos > 0, batch, NULL)) OVER (PARTITION BY doc ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), batch) AS prev FROM w),
    x AS (
        SELECT doc, prev AS batch, batch * 2 AS n, if(pos > 0, left(text, CAST(pos - 2 AS INTEGER)), if(text LIKE '%' || chr(10), left(text, length(text) - 1), text)) AS text FROM b WHERE pos <> 1
        UNION ALL SELECT doc, batch, batch * 2 + 1, substring(text, CAST(pos AS INTEGER)) FROM b WHERE pos > 0),
    y AS (SELECT doc, batch, string_agg(text, chr(10) ORDER BY n) AS text FROM x GROUP BY 1, 2)
    SELECT doc, batch, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n FROM y WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100""",
    prelude=False,
)
def text_batches(spark, sf_dir):
    body, mark = F.coalesce("text", F.lit("")), F.concat((F.col("doc_id") % 900 + 100).cast("string"), F.lit("、 "))
    turn = F.col("doc_id") % 5
    text = F.when(turn == 0, F.concat(body, F.lit("\n"), mark, body)).when(turn == 1, F.concat(mark, body)).otherwise(body)
    text = F.concat(text, F.when(F.col("doc_id") % 19 == 7, F.lit("\n参考答案")).otherwise(F.lit("")))
    pages = T.read(spark, sf_dir, "documents", "doc_id", "text").select(F.floor(F.col("doc_id") / 23).alias("doc"), (F.col("doc_id") % 23).cast("int").alias("page"), text.alias("text"))
    return B.batches(pages, mark=MARK).select("doc", "batch", F.md5("text").alias("digest"), F.length("text").alias("n"))
