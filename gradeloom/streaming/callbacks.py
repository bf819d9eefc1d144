"""Batches of parsed questions as they are called back: a file source, replayed to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "task string, batch_no int, seq long, event_time timestamp, temp_id string, index_num int, content string, score double"


def callback_stream(spark: SparkSession, path: str, schema: str = QUESTION, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def saved(stream: DataFrame, out: str, checkpoint: str, paused: DataFrame | None = None, key: str = "task"):
    """Appends each batch; rows of paused tasks are passed over.  A batch that is replayed
    after a failure writes the same folder again, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if paused is None else batch.join(F.broadcast(paused.select(key)), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Rows sent again (there is no key of the sender's) are dropped within a span of time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counters(stream: DataFrame, at: str, status: str, late: str = "1 hour") -> DataFrame:
    """Per day: how many tasks, and how many of each outcome."""
    count = lambda s: F.count_if(F.col(status) == s)
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("total"), count("done").alias("done"), count("failed").alias("failed"))


def pending(left: DataFrame, done: DataFrame, keys: list[str], again: Column | None = None) -> DataFrame:
    """What is not done yet, and what is to be done again."""
    missing = left.join(done.select(*keys).distinct(), keys, "left_anti")
    if again is None:
        return missing
    return missing.unionByName(left.join(done.where(again).select(*keys).distinct(), keys, "left_semi"))
