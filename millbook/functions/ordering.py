"""Sort keys with PostgreSQL null placement (NULLS LAST on ASC, FIRST on DESC).

Text sorts by code point unless a collation is named: a Spark collation such as
``es`` or ``de_DE`` (ICU rules, as a database created with that locale sorts:
accents and case decide only between otherwise equal words), or one with a
suffix such as ``es_CI``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collated(c: str | Column, collation: str | None) -> Column:
    """``c`` as a sort key under ``collation``; None: by code point."""
    return F.collate(_col(c), collation) if collation else _col(c)


def asc(c: str | Column, collation: str | None = None) -> Column:
    return collated(c, collation).asc_nulls_last()


def desc(c: str | Column, collation: str | None = None) -> Column:
    return collated(c, collation).desc_nulls_first()


def sort_keys(*spec: str) -> list[Column]:
    """``sort_keys('date desc', 'id')`` -> PostgreSQL-ordered Spark sort keys."""
    keys = []
    for item in spec:
        parts = item.split()
        keys.append(desc(parts[0]) if len(parts) > 1 and parts[1].lower() == "desc" else asc(parts[0]))
    return keys
