"""Optional-parameter predicates: an absent parameter adds no filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DateLike = str | dt.date | None


def _present(value) -> bool:
    # JS truthiness of request parameters: '' / 0 / None mean "not given"
    return value is not None and value != "" and value != 0


def contains(column: str | Column, text: str) -> Column:
    """``col ILIKE '%text%'``; ``%``, ``_`` and ``\\`` in ``text`` stay wildcards."""
    col = F.col(column) if isinstance(column, str) else column
    return col.ilike(f"%{text}%")


def any_contains(columns: Iterable[str | Column], text: str) -> Column:
    cond = None
    for c in columns:
        part = contains(c, text)
        cond = part if cond is None else (cond | part)
    return cond


def _date_lit(value: DateLike) -> Column:
    if isinstance(value, dt.date):
        return F.lit(value)
    return F.lit(value).cast(T.DateType())


def bound(column: str | Column, start: DateLike = None, end: DateLike = None) -> Column | None:
    """Inclusive ``start <= col <= end``, each side optional.

    On a timestamp column a bare date bound means midnight, so the end day
    itself is excluded; on a date column it is included. Literals are cast
    to the column's type by Catalyst, which keeps the predicate pushable.
    """
    col = F.col(column) if isinstance(column, str) else column
    cond = None
    if _present(start):
        cond = col >= _date_lit(start)
    if _present(end):
        part = col <= _date_lit(end)
        cond = part if cond is None else (cond & part)
    return cond


def apply_filters(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Fold ``df.filter`` over the conditions that are present."""
    for cond in conditions:
        if cond is not None:
            df = df.filter(cond)
    return df


def equals(column: str, value) -> Column | None:
    return (F.col(column) == F.lit(value)) if _present(value) else None


def search(columns: Iterable[str], text: str | None) -> Column | None:
    return any_contains(columns, text) if _present(text) else None


def active(column: str = "is_active") -> Column:
    return F.col(column) == F.lit(True)
