"""Tiny hand-made ERP tables for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from millbook.sources.schemas import ERP_SCHEMAS
from millbook.sources.tables import Tables


def D(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def make_tables(spark, **rows) -> Tables:
    """A bundle with the given rows per ERP table (dicts by column) and empty others."""
    frames = {}
    for name, schema in ERP_SCHEMAS.items():
        data = rows.get(name, [])
        tuples = [tuple(r.get(f.name) for f in schema.fields) for r in data]
        frames[name] = spark.createDataFrame(tuples, schema)
    for name, df in rows.items():
        if name not in ERP_SCHEMAS:
            frames[name] = df
    return Tables(frames)
