"""Order within a group: latest, neighbours, runs, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, group: list[str], at: str, unique: str) -> DataFrame:
    """Each group's newest row."""
    w = Window.partitionBy(*group).orderBy(F.desc(at), F.desc(unique))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def wrong_book(records: DataFrame, group: list[str], key: str, at: str) -> DataFrame:
    """Of rows with the same key the oldest, in order of the newest: ``newest`` is to sort by."""
    own = Window.partitionBy(*group, key)
    oldest = F.row_number().over(own.orderBy(F.asc(at)))
    return records.withColumns({"newest": F.max(at).over(own), "_n": oldest}).where(F.col("_n") == 1).drop("_n")


def neighbours(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def top_list(df: DataFrame, group: list[str], order: list[Column], value: str, most: int, name: str) -> DataFrame:
    """Each group's first values, as an array in order."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = df.withColumn("_n", n).where(F.col("_n") <= most)
    pairs = F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v"))))
    return top.groupBy(*group).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def carried(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The latest value that isn't null, at or before each row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def segments(df: DataFrame, group: list[str], order: str, marker: Column, name: str = "segment") -> DataFrame:
    """A number that goes up by one at each marker; 0 before the first."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(marker, 1).otherwise(0)).over(w))


def blocks(df: DataFrame, group: list[str], order: str, marker: Column, drop: Column, text: str) -> DataFrame:
    """What lies between markers, one row each: its first and last place and its text, lines
    to drop left out."""
    own = segments(df, group, order, marker).where((F.col("segment") > 0) & ~drop)
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return own.groupBy(*group, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.transform(gathered, lambda x: x["t"]), "\n").alias("text"))


def context(df: DataFrame, group: list[str], order: str, value: str, before: int, after: int) -> DataFrame:
    """The values of so many rows before and after each row."""
    w = Window.partitionBy(*group).orderBy(order)
    out = {}
    if before:
        out["before"] = F.array_join(F.collect_list(value).over(w.rowsBetween(-before, -1)), " ")
    if after:
        out["after"] = F.array_join(F.collect_list(value).over(w.rowsBetween(1, after)), " ")
    return df.withColumns(out)


def recent(df: DataFrame, group: list[str], order: str, value: str, most: int, name: str = "recent") -> DataFrame:
    """The last values up to each row, itself included."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(1 - most, 0)
    return df.withColumn(name, F.collect_list(value).over(w))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def repeats(df: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Whether a row's key was there before in its group; null keys never were."""
    n = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return df.withColumn("is_repeat", F.col(key).isNotNull() & (n > 1))


def first_seen(df: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Rows whose key wasn't there before."""
    return repeats(df, group, key, order).where(~F.col("is_repeat")).drop("is_repeat")


def shifted(df: DataFrame, index: str, after: int, by: int = 1) -> DataFrame:
    """Indexes beyond one go up, to make room for a new one."""
    return df.withColumn(index, F.when(F.col(index) > after, F.col(index) + by).otherwise(F.col(index)))


def preface(df: DataFrame, group: list[str], order: str, marker: Column, stop: Column) -> DataFrame:
    """Rows that lead up to the next marker without a stop in between."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    ends = F.first(F.when(marker, F.lit("m")).when(stop, F.lit("s")), ignorenulls=True).over(w)
    own = df.withColumns({"_end": ends, "_marker": marker, "_stop": stop})
    return own.where((F.col("_end") == "m") & ~F.col("_marker") & ~F.col("_stop")).drop("_end", "_marker", "_stop")


def rises(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Whether a value is not below the one before it; the first is not below any."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("rises", before.isNull() | (F.col(value) >= before))


def islands(df: DataFrame, group: list[str], order: str, start: str, end: str, gap: float) -> DataFrame:
    """Intervals in order, joined where the next begins within a gap of the end so far."""
    so_far = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(so_far)
    return segments(df.withColumn("_reach", reach), group, order, F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), "island").drop("_reach")
