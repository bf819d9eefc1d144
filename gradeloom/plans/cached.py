"""Queries over what runs keep: pages' results and sets of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.plans.registry import query
from gradeloom.sources import tables as T
from gradeloom.sources.artifacts import ArtifactSet
from gradeloom.sources.page_cache import PageCache, cache_counts, page_key
from gradeloom.sources.shared import shared_dir, written


@query(
    """WITH d AS (SELECT sha256(coalesce(text, '')) AS k, length(coalesce(text, '')) AS n, doc_id IN (SELECT doc_id FROM labels) AS fine FROM documents),
    r AS (
        SELECT 1 AS run, k, n, 110 AS dpi, false AS hit FROM d
        UNION ALL SELECT 2, k, n, if(fine, 220, 110), NOT fine FROM d
        UNION ALL SELECT 3, k, n, if(fine, 220, 110), n >= 200 FROM d
        UNION ALL SELECT 4, k, n, if(fine, 220, 110), true FROM d)
    SELECT run, count(*) AS rows, count(*) FILTER (hit) AS cache_hits, count(DISTINCT if(hit, NULL, k || dpi)) AS cache_misses, count(*) FILTER (n < 200) AS failed,
           CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY 1""",
    prelude=False,
)
def page_cache_runs(spark, sf_dir):
    """Four runs over all documents as pages: from nothing; with labelled ones rendered finer;
    with those that failed retried; and the same again, which makes nothing."""
    cache = PageCache(spark, shared_dir(spark), StructType().add("chars", "long"))
    fine = T.read(spark, sf_dir, "labels", "doc_id").distinct().withColumn("fine", F.lit(True))
    docs = T.read(spark, sf_dir, "documents", "doc_id", "text").join(fine, "doc_id", "left").select(F.coalesce("text", F.lit("")).alias("text"), "fine")

    def make(pages: DataFrame) -> DataFrame:
        n = F.char_length("text").cast("long")
        return pages.select("cache_key", (n < 200).alias("failed"), n.alias("chars"))

    def run(number: int, dpi, **how) -> DataFrame:
        key = page_key(F.col("text"), F.lit(0), dpi, F.lit(1600))
        found = cache.run(docs.select("text", key.alias("cache_key")), make, **how)
        return written(found.select(F.lit(number).alias("run"), "cache_key", "cache_hit", "failed", "chars"))

    mixed = F.when(F.col("fine"), F.lit(220)).otherwise(F.lit(110))
    runs = reduce(DataFrame.union, [run(1, F.lit(110)), run(2, mixed), run(3, mixed, retry_failed=True), run(4, mixed)])
    return cache_counts(runs, ["run"]).join(runs.groupBy("run").agg(F.sum("chars").alias("chars")), "run")


@query(
    """WITH a AS (
        SELECT 'final-questions' AS artifact, p_brand, p_partkey FROM part WHERE p_size % 3 <> 0
        UNION ALL SELECT 'ai-audit-results', p_brand, p_partkey FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT 'recrop-plan', p_brand, p_partkey FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT 'paper-candidate-payload', p_brand, p_partkey FROM part WHERE p_retailprice > 1500)
    SELECT artifact, p_brand AS task, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM a GROUP BY 1, 2""",
    prelude=False,
)
def artifact_sets(spark, sf_dir):
    """What a second publication leaves of each artifact and task, read back."""
    kept = ArtifactSet(spark, shared_dir(spark))
    n = F.col("p_size")
    rows = T.read(spark, sf_dir, "part").withColumn("task", F.col("p_brand"))
    own = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    kept.publish(rows, {"final-questions": (n % 5 == 0, own)}, ["task"])
    kept.publish(rows, {"final-questions": (n % 3 != 0, own), "ai-audit-results": (n % 2 == 0, own), "recrop-plan": (n % 7 == 0, own), "paper-candidate-payload": (F.col("p_retailprice") > 1500, own)}, ["task"])
    counts = kept.manifest()["counts"]
    read = [kept.read(a, "id long, name string, task string").withColumn("artifact", F.lit(a)) for a in counts]
    return reduce(DataFrame.unionByName, read).groupBy("artifact", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
