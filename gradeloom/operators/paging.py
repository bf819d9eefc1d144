"""Filters, sorts and pages of listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTABLE = ("index_num", "created_at", "parse_confidence", "answer_count", "correct_rate", "page_num")


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet all conditions given; None is no condition."""
    own = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, own)) if own else df


def equal(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def has_images(column: str, wanted: bool | None) -> Column | None:
    if wanted is None:
        return None
    has = F.col(column).isNotNull() & (F.size(column) > 0)
    return has if wanted else ~has


def sorted_by(df: DataFrame, column: str, direction: str, unique: str, allowed: tuple[str, ...] = SORTABLE) -> list[Column]:
    """An order by an allowed column, nulls last, made unique."""
    if column not in allowed:
        raise ValueError(f"can't sort by {column}")
    c = F.col(column)
    return [c.desc_nulls_last() if direction.upper() == "DESC" else c.asc_nulls_last(), F.col(unique).asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    if number < 1 or size < 1:
        raise ValueError("pages are numbered, and sized, from 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_in_group(df: DataFrame, group: list[str], order: list[Column], number: int, size: int) -> DataFrame:
    """Each group's own page, cut after whatever made the rows distinct."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", n).where(F.col("position").between((number - 1) * size + 1, number * size))


def in_given_order(df: DataFrame, column: str, wanted: list, then: list[str]) -> list[Column]:
    """An order by a given list; what isn't in it comes last."""
    place = F.nullif(F.array_position(F.lit(wanted), F.col(column)), F.lit(0))
    return [place.asc_nulls_last(), *[F.col(c) for c in then]]


def shuffled(df: DataFrame, seed: int, most: int) -> DataFrame:
    """So many rows in a seeded order."""
    return df.orderBy(F.rand(seed)).limit(most)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)
