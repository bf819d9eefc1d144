"""Joins on ranges, nearness, boxes and positions, always with an equality on what bounds a
group (a document, a page, a bank), so that no pair is formed across groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G
from gradeloom.operators.regions import box_join


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, low: str, high: str, order: str, keep: str = "first") -> DataFrame:
    """Each point with the first or last (by ``order``) of the ranges of its group that hold
    it, or with none.  Ranges of a group are gathered, sorted, into one array of structs, so
    points don't multiply."""
    names = [c for c in ranges.columns if c not in on]
    own = F.struct(F.col(order).alias("_order"), *[F.col(c) for c in names if c != order])
    gathered = ranges.groupBy(*on).agg(F.array_sort(F.collect_list(own)).alias("_ranges"))
    at = lambda r, c: r["_order"] if c == order else r[c]
    inside = F.filter("_ranges", lambda r: (F.col(point) >= at(r, low)) & (F.col(point) <= at(r, high)))
    hit = F.get(inside, 0 if keep == "first" else F.size(inside) - 1)
    out = points.join(gathered, on, "left").withColumn("_hit", hit)
    return out.select(*points.columns, *[at(F.col("_hit"), c).alias(c) for c in names])


def current_range(rows: DataFrame, group: list[str], order: str, start: str, end: str, point: str, name: str) -> DataFrame:
    """Rows in order, some of which open a range [start, end]: whether the latest opened one
    holds a row's point, and then its start."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col(start).isNotNull(), F.struct(F.col(start).alias("s"), F.col(end).alias("e"))), ignorenulls=True).over(before)
    out = rows.withColumn("_latest", latest)
    return out.withColumn(name, F.when(F.col(point).between(F.col("_latest.s"), F.col("_latest.e")), F.col("_latest.s"))).drop("_latest")


def following(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, most: int | None = None, name: str = "following") -> DataFrame:
    """As-of join forwards: the value of the first right row after each left row, if it is not
    too far.  One sort of both sides together, no pairs."""
    both = left.withColumns({"_right": F.lit(False), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(*on, F.col(at), F.lit(True).alias("_right"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    # at equal places a right row does not follow a left one
    after = Window.partitionBy(*on).orderBy(F.col(at), F.col("_right").desc()).rowsBetween(1, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("_right"), F.struct(F.col(at).alias("at"), F.col("_value").alias("v"))), ignorenulls=True).over(after)
    out = both.withColumn("_hit", hit).where(~F.col("_right"))
    near = F.lit(True) if most is None else F.col("_hit.at") - F.col(at) <= most
    return out.withColumn(name, F.when(near, F.col("_hit.v"))).select(*left.columns, name)


def preceding(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, name: str = "preceding") -> DataFrame:
    """As-of join backwards: the value of the last right row at or before each left row."""
    both = left.withColumns({"_right": F.lit(False), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(*on, F.col(at), F.lit(True).alias("_right"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    before = Window.partitionBy(*on).orderBy(F.col(at), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.last(F.when(F.col("_right"), F.col("_value")), ignorenulls=True).over(before)
    return both.withColumn(name, hit).where(~F.col("_right")).select(*left.columns, name)


def without_duplicates_of(fallback: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Fallback boxes that no other box of the page covers: by 30% of area, or near above or
    below and 60% in width."""
    covered = lambda a, b: (G.overlap_ratio(a, b) >= 0.3) | ((G.x_overlap(a, b) >= 0.6) & (G.y_gap(a, b) <= 80))
    return box_join(fallback, others, on, covered, "left_anti", margin=(0.0, 80.0))


def by_key_or_position(left: DataFrame, right: DataFrame, key: str, position: str, value: str, name: str) -> DataFrame:
    """The right value of the same key; else that of the same position."""
    by_key = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(value, position).alias("_by_key"))
    by_place = right.select(F.col(position).alias("_p"), F.col(value).alias("_by_place"))
    out = left.join(by_key, F.col(key) == F.col("_k"), "left").join(by_place, F.col(position) == F.col("_p"), "left")
    return out.withColumn(name, F.coalesce("_by_key", "_by_place")).drop("_k", "_p", "_by_key", "_by_place")


def filled(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Blank or null values taken from the right."""
    own = F.nullif(F.trim(F.col(column)), F.lit(""))
    other = right.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return left.join(other, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce(own, "_v")).drop("_k", "_v")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """References that lead nowhere."""
    return left.where(F.col(key).isNotNull()).join(right.select(key).distinct(), key, "left_anti")


def is_valid_selection(wanted: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """One row: how many of the wanted keys are not to be had, and whether all are."""
    return missing(wanted.select(key).distinct(), published, key).agg(F.count(F.lit(1)).alias("unknown")).withColumn("ok", F.col("unknown") == 0)


def remapped(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Temporary ids replaced by those they were saved under; unknown ones become null."""
    own = mapping.select(F.col("temp_id").alias("_t"), F.col("id").alias("_i"))
    return df.join(own, F.col(column) == F.col("_t"), "left").withColumn(column, F.col("_i")).drop("_t", "_i")


def neighbours_touch(pages: Column, page: Column) -> Column:
    """Whether any of the pages is the one given or next to it."""
    return F.arrays_overlap(pages, F.sequence(page - 1, page + 1))


def checked(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each expectation that fails: missing, or the names of columns that differ."""
    both = expected.alias("e").join(actual.withColumn("_there", F.lit(True)).alias("a"), key, "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    out = both.select(key, F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(differ).alias("failures"))
    return out.where(F.size("failures") > 0)
