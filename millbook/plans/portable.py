"""Presentation casts for cross-engine comparison.

Operators return exact decimals and dates. For the SQL-oracle check the
registered queries present decimals as double (an exact decimal converts to
the same nearest double in both engines) and dates as timestamp_ntz, the
forms both engines hand to pandas/Arrow alike. Nested arrays of structs are
cast element-wise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _portable_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, T.DateType):
        return T.TimestampNTZType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_portable_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _portable_type(f.dataType), f.nullable) for f in dtype.fields])
    return dtype


def portable(df: DataFrame, nullable_ints: tuple[str, ...] = ()) -> DataFrame:
    """Decimals -> double, dates -> timestamp_ntz; ``nullable_ints`` -> double.

    An integer column holding NULLs reaches pandas as float64 from Spark but
    as a nullable integer from DuckDB, so such columns are presented as
    double on both sides.
    """
    cols: list[Column] = []
    for field in df.schema.fields:
        target = _portable_type(field.dataType)
        if field.name in nullable_ints:
            target = T.DoubleType()
        c = F.col(f"`{field.name}`")
        cols.append(c.cast(target).alias(field.name) if target != field.dataType else c)
    return df.select(*cols)
