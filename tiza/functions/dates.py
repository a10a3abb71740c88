"""Date and time Column builders. All take the time as a column, so that results don't depend on when a query runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with milliseconds and Z, of a time in the session's zone, which should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def code_expiry(ts: Column) -> Column:
    """When a one-time code made at ts expires: ten minutes later."""
    return ts + F.expr("INTERVAL 10 MINUTES")


def days_later(ts: Column, days: Column | int) -> Column:
    """ts plus whole days, such as a plan's days of validity; null where either is."""
    return ts + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def day_month_year(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")
