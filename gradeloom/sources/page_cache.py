"""Results of pages that are costly to make, kept by what they were made from.

A page's key is its file's sha256, its number and how it is rendered, so the same page asked
for again, under whatever name, is found, and one rendered in another way is not.  A run reads
what is kept, makes what is missing, once a key, and publishes that as one entry: a folder
that is written apart and then renamed, so a run that fails midway leaves nothing.  A key's
latest entry counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def page_key(content: Column, page: Column, dpi: Column, max_side: Column) -> Column:
    """The key; a null content is an empty file, a null side no bound."""
    name = F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256)
    return F.concat(name, F.lit("_p"), page.cast("string"), F.lit("_dpi"), dpi.cast("string"), F.lit("_max"), F.coalesce(max_side.cast("string"), F.lit("none")))


class PageCache:
    """``folder`` is shared; ``result`` is the schema of what is kept for a page (without
    cache_key and failed, which are always there)."""

    def __init__(self, spark: SparkSession, folder: str, result: StructType):
        self.spark, self.folder = spark, folder
        self.result = result.fieldNames()
        self.schema = StructType(list(result.fields)).add("cache_key", "string").add("failed", "boolean")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def entries(self) -> list[str]:
        """Names of published entries, oldest first."""
        files, path = self._files()
        top = path(f"{self.folder}/entries")
        return sorted(s.getPath().getName() for s in files.listStatus(top)) if files.exists(top) else []

    def kept(self) -> DataFrame:
        """Each key's latest result."""
        names = self.entries()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/entries/{n}" for n in names])
        entry = F.regexp_extract("_metadata.file_path", r"/entries/([^/]+)/", 1)
        row = F.struct(*[c for c in self.schema.fieldNames() if c != "cache_key"])
        return rows.groupBy("cache_key").agg(F.max_by(row, entry).alias("_row")).select("cache_key", "_row.*")

    def _publish(self, rows: DataFrame) -> None:
        files, path = self._files()
        apart = f"{self.folder}/apart-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(apart)
        files.mkdirs(path(f"{self.folder}/entries"))
        name = f"{len(self.entries()):08d}-{uuid.uuid4().hex}"
        if not files.rename(path(apart), path(f"{self.folder}/entries/{name}")):
            raise RuntimeError(f"{apart} could not be published")

    def run(self, pages: DataFrame, make: Callable[[DataFrame], DataFrame], read: bool = True, refresh: bool = False, retry_failed: bool = False) -> DataFrame:
        """``pages`` (with cache_key) with their results, failed and cache_hit.

        ``make`` gets a row a key that is missing and returns cache_key, failed and the result.
        ``refresh`` makes all anew, ``retry_failed`` those that failed; without ``read``
        nothing is read or kept for them either, but they are published all the same."""
        kept = self.kept()
        usable = kept.where(F.lit(read and not refresh) & ~(F.lit(retry_failed) & F.col("failed")))
        before = self.entries()
        missing = pages.dropDuplicates(["cache_key"]).join(usable.select("cache_key"), "cache_key", "left_anti")
        if not missing.isEmpty():
            self._publish(make(missing))
        new = [n for n in self.entries() if n not in before]
        made = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/entries/{n}" for n in new]) if new else self.spark.createDataFrame([], self.schema)
        found = usable.withColumn("cache_hit", F.lit(True)).unionByName(made.withColumn("cache_hit", F.lit(False)))
        return pages.join(found, "cache_key", "left")


def cache_counts(results: DataFrame, group: list[str]) -> DataFrame:
    """rows, cache_hits (rows), cache_misses (keys that were made) and failed of runs."""
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("cache_hit").alias("cache_hits"),
        F.count_distinct(F.when(~F.col("cache_hit"), F.col("cache_key"))).alias("cache_misses"), F.count_if("failed").alias("failed"),
    )
