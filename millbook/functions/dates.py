"""Relative dates from an explicit ``as_of`` (the stand-in for CURRENT_DATE)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def month_start(as_of: str | dt.date) -> dt.date:
    return as_date(as_of).replace(day=1)


def week_start(as_of: str | dt.date) -> dt.date:
    d = as_date(as_of)
    return d - dt.timedelta(days=d.weekday())  # weeks start on Monday


def year_start(as_of: str | dt.date) -> dt.date:
    return as_date(as_of).replace(month=1, day=1)


def bucket(unit: str, column: str | Column) -> Column:
    """``DATE_TRUNC(unit, col)`` for a date or timestamp_ntz column, as timestamp_ntz.

    Built from wall-clock date parts, so the result does not depend on the
    session time zone (``date_trunc`` goes through a zoned timestamp, which
    moves wall times that a daylight-saving change skips). Weeks start on Monday.
    """
    col = F.col(column) if isinstance(column, str) else column
    zero = F.lit(0)
    if unit == "week":
        return F.trunc(F.to_date(col), "week").cast(T.TimestampNTZType())
    y, m, d = F.year(col), F.month(col), F.dayofmonth(col)
    parts = {
        "hour": (y, m, d, F.hour(col)),
        "day": (y, m, d, zero),
        "month": (y, m, F.lit(1), zero),
        "year": (y, F.lit(1), F.lit(1), zero),
    }[unit]
    return F.make_timestamp_ntz(*parts, zero, zero)


def period_plan(period: str | None, as_of: str | dt.date, start=None, end=None):
    """The (date filter, bucket) pair of the sales dashboard.

    Both dates given -> day buckets over that inclusive range. Otherwise by
    ``period``: ``today`` -> hours of ``created_at`` since today; ``weekly`` ->
    days since Monday; ``monthly`` -> days since the 1st; ``yearly`` -> months
    since 1 January; anything else (``daily`` included) -> days of the last 7.
    Returns ``(condition, bucket_column)``.
    """
    od = F.col("order_date")
    if start and end:
        return od.between(F.lit(as_date(start)), F.lit(as_date(end))), bucket("day", od)
    today = as_date(as_of)
    if period == "today":
        return od >= F.lit(today), bucket("hour", "created_at")
    if period == "weekly":
        return od >= F.lit(week_start(today)), bucket("day", od)
    if period == "monthly":
        return od >= F.lit(month_start(today)), bucket("day", od)
    if period == "yearly":
        return od >= F.lit(year_start(today)), bucket("month", od)
    return od >= F.lit(today - dt.timedelta(days=7)), bucket("day", od)
