"""Calendar rules. Timestamps are TIMESTAMP_NTZ holding UTC; the reporting zone is a
fixed +03:00 offset (no daylight saving), so it is plain interval arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspectra.schema import PERIOD_TYPES, UTC_OFFSET_HOURS

_OFFSET = f"INTERVAL '{UTC_OFFSET_HOURS}' HOUR"
_STEP = {"day": "INTERVAL '1' DAY", "week": "INTERVAL '7' DAY",
         "month": "INTERVAL '1' MONTH", "year": "INTERVAL '1' YEAR"}


def _check(period: str) -> str:
    if period not in PERIOD_TYPES:
        raise ValueError(f"period must be one of {PERIOD_TYPES}, got {period!r}")
    return period


def local_date(ts: Column) -> Column:
    """Calendar day of a UTC timestamp in the reporting zone."""
    return F.to_date(ts + F.expr(_OFFSET))


def period_start(day: Column, period: str) -> Column:
    """First day of the bucket holding ``day`` (weeks start on Monday)."""
    return day if _check(period) == "day" else F.trunc(day, period)


def period_end(start: Column, period: str) -> Column:
    """First day after the bucket that begins on ``start``."""
    if _check(period) in ("day", "week"):
        return F.date_add(start, 1 if period == "day" else 7)
    return F.add_months(start, 1 if period == "month" else 12)


def period_sequence(first_day: Column, last_day: Column, period: str) -> Column:
    """Array of all bucket starts covering [first_day, last_day]."""
    return F.sequence(period_start(first_day, period), period_start(last_day, period),
                      F.expr(_STEP[_check(period)]))


def period_spine(spark: SparkSession, first_day: dt.date, last_day: dt.date,
                 period: str) -> DataFrame:
    """All bucket starts between two days, one row each; empty when the days are swapped."""
    if first_day > last_day:
        return spark.createDataFrame([], "period_start date")
    days = period_sequence(F.lit(first_day), F.lit(last_day), period)
    return spark.range(1).select(F.explode(days).alias("period_start"))


def _utc_midnight(day: dt.date) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{day.isoformat()} 00:00:00' - {_OFFSET}")


def in_date_range(ts: Column, date_from: dt.date | None, date_to: dt.date | None) -> Column:
    """Inclusive local days as a half-open range on the raw column.

    The literal is shifted, not the column, so the predicate reaches the parquet scan.
    """
    condition = F.lit(True)
    if date_from is not None:
        condition = condition & (ts >= _utc_midnight(date_from))
    if date_to is not None:
        condition = condition & (ts < _utc_midnight(date_to + dt.timedelta(days=1)))
    return condition


def micros_since(ts: Column, origin: dt.datetime) -> Column:
    """Whole microseconds from ``origin`` to ``ts``, independent of the session zone."""
    days = F.datediff(F.to_date(ts), F.lit(origin.date())).cast("long")
    micros = ((F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60) * 1_000_000
              + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))
    start = origin - dt.datetime.combine(origin.date(), dt.time())
    return days * 86_400_000_000 + micros - int(start / dt.timedelta(microseconds=1))
