"""Numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def progress(done: Column, total: Column) -> Column:
    """Percent shown while a task runs: from 15 to 95."""
    return F.when(total > 0, clamp(F.round(done / total * 90), 15, 95)).otherwise(F.lit(15.0)).cast("int")


def number_or(text: Column, fallback: float | None = None) -> Column:
    """A finite number from text.  Null and blank text count as 0, as they do where the numbers
    come from; what isn't a number becomes the fallback."""
    trimmed = F.trim(text)
    value = F.when(text.isNull() | (trimmed == ""), F.lit(0.0)).otherwise(trimmed.try_cast("double"))
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return F.coalesce(finite, F.lit(fallback).cast("double"))


def whole_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def count_if(condition: Column) -> Column:
    """How often a condition holds; never null."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
