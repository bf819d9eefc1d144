"""Pages are made once; a run that fails publishes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.sources.page_cache import PageCache, cache_counts, page_key


@pytest.fixture()
def cache(spark, tmp_path):
    return PageCache(spark, str(tmp_path / "cache"), StructType().add("n", "long"))


class Make:
    """Counts what it is asked to make."""

    def __init__(self):
        self.asked = []

    def __call__(self, pages):
        rows = pages.select("cache_key", "text").collect()
        self.asked.append(len(rows))
        return pages.select("cache_key", (F.length("text") < 2).alias("failed"), F.length("text").cast("long").alias("n"))


def pages(spark, texts, dpi=110):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return df.withColumn("cache_key", page_key(F.col("text"), F.lit(3), F.lit(dpi), F.lit(None).cast("int")))


def test_second_run_makes_nothing(spark, cache):
    make = Make()
    first = cache.run(pages(spark, ["ab", "ab", "c", None]), make).collect()
    assert make.asked == [3] and [r.cache_hit for r in first] == [False] * 4
    again = cache.run(pages(spark, ["c", "ab"]), make).collect()
    assert make.asked == [3] and {(r.text, r.n, r.cache_hit) for r in again} == {("c", 1, True), ("ab", 2, True)}
    assert len(cache.entries()) == 1
    more = cache.run(pages(spark, ["ab", "new"]), make)
    assert {(r.text, r.cache_hit) for r in more.collect()} == {("ab", True), ("new", False)} and make.asked == [3, 1]
    cache.run(pages(spark, ["ab"], 220), make).collect()
    assert make.asked == [3, 1, 1]  # another way to render


def test_retry_and_refresh(spark, cache):
    make = Make()
    cache.run(pages(spark, ["ab", "c"]), make)
    retried = cache.run(pages(spark, ["ab", "c"]), make, retry_failed=True)
    assert make.asked == [2, 1] and {(r.text, r.cache_hit) for r in retried.collect()} == {("ab", True), ("c", False)}
    counts = cache_counts(retried.withColumn("run", F.lit(1)), ["run"]).first()
    assert (counts["rows"], counts["cache_hits"], counts["cache_misses"], counts["failed"]) == (2, 1, 1, 1)
    cache.run(pages(spark, ["ab", "c"]), make, refresh=True)
    cache.run(pages(spark, ["ab"]), make, read=False)
    assert make.asked == [2, 1, 2, 1]
    assert cache.kept().count() == 2  # the latest of each key


def test_failed_run_publishes_nothing(spark, cache):
    def broken(df):
        return df.select("cache_key", F.lit(False).alias("failed"), F.raise_error(F.lit("down")).cast("long").alias("n"))

    with pytest.raises(Exception, match="down"):
        cache.run(pages(spark, ["ab"]), broken)
    assert cache.entries() == [] and cache.kept().count() == 0
    assert cache.run(pages(spark, []), Make()).count() == 0
