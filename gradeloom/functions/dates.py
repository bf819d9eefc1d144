"""Dates.  Now is always an argument, and the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_of_day(as_of: Column) -> Column:
    return F.date_trunc("day", as_of)


def start_of_week(as_of: Column) -> Column:
    """Monday 00:00."""
    return F.date_trunc("week", as_of)


def period_start(period: str, as_of: Column) -> Column:
    """Where a leaderboard's period begins: today, 7 or 30 days before today's start."""
    back = {"today": 0, "week": 7, "month": 30}[period]
    return start_of_day(as_of) - F.expr(f"INTERVAL {back} DAYS")


def days_before(as_of: Column, days: int) -> Column:
    """To the second, not to midnight."""
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def seconds_of(span: Column) -> Column:
    """``7d``, ``2h``, ``30m`` or ``45s`` in seconds; a bare number is seconds."""
    n = F.regexp_extract(span, r"^(\d+)\s*([dhms]?)$", 1).try_cast("long")
    unit = F.regexp_extract(span, r"^(\d+)\s*([dhms]?)$", 2)
    return n * F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
