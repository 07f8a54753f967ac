"""Names of request columns as clients send them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def snake_case(name: str) -> str:
    """``camelCase`` to ``camel_case``: every capital becomes an underscore and its small letter."""
    return re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)


def snake_columns(df: DataFrame) -> DataFrame:
    """A change set with its columns renamed to the stored tables' spelling (names only; no rows are read)."""
    return df.toDF(*[snake_case(c) for c in df.columns])
