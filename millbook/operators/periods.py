"""K1 over a period: a stored ledger by month, with marks that spare reading the months before.

The ledger is stored in month folders. Beside it every append writes what the
batch adds to each (product, month): marks, which merge by adding. A period's
opening balance is the marks of the months before it, so its ledger reads the
marks and the period's own month folders and nothing else, however old the ledger
is. Late movements belong to their month: they change its folder and its mark.
Movements without a time come before all others, as in the kardex.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions import dates as D
from millbook.operators.ledger import kardex
from millbook.sources.schemas import ERP_SCHEMAS
from millbook.sources.tables import Tables

NO_MONTH = 0
_WIDE = T.DecimalType(28, 2)


def month_of(column: str | Column) -> Column:
    """Year and month as one number (199703); ``NO_MONTH`` without a time."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.year(c) * 100 + F.month(c), F.lit(NO_MONTH)).cast("int")


def append_ledger(movements: DataFrame, root: str, batch_id: str) -> None:
    """Add ``movements`` to the ledger under ``root`` and their sums to its marks.

    A batch has folders of its own below each month, replaced when it runs again,
    so a batch that failed half way is simply repeated. The marks are written
    last; readers take the batches that have them.
    """
    kinds = [f for f in ERP_SCHEMAS["inventory_movements"].fields if f.name in movements.columns]
    rows = movements.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).withColumn(
        "month", month_of("moved_at")).withColumn("load_id", F.lit(batch_id))
    (rows.repartitionByRange("month", "product_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "load_id").parquet(os.path.join(root, "ledger")))
    (rows.groupBy("product_id", "month").agg(F.sum("quantity").cast(_WIDE).alias("moved"))
     .write.mode("overwrite").parquet(os.path.join(root, "marks", f"load_id={batch_id}")))


def marks(spark: SparkSession, root: str) -> DataFrame:
    """``product_id, month, moved, load_id``: what each batch added to each month."""
    schema = T.StructType().add("product_id", T.LongType()).add("month", T.IntegerType()).add("moved", _WIDE).add("load_id", T.StringType())
    return spark.read.schema(schema).parquet(os.path.join(root, "marks"))


def stored_ledger(spark: SparkSession, root: str, months: tuple[int, int]) -> DataFrame:
    """The movements of the months from ``months[0]`` to ``months[1]``: other folders are not read."""
    fields = ERP_SCHEMAS["inventory_movements"].fields
    schema = T.StructType([*fields, T.StructField("month", T.IntegerType()), T.StructField("load_id", T.StringType())])
    rows = spark.read.schema(schema).parquet(os.path.join(root, "ledger")).filter(F.col("month").between(*months))
    loads = marks(spark, root).select("load_id").distinct()
    return rows.join(loads, "load_id", "left_semi").drop("month", "load_id")


def kardex_between(spark: SparkSession, root: str, start, end) -> DataFrame:
    """The kardex rows with ``start <= moved_at < end`` (dates: midnights), each with its balances.

    What the full kardex holds for that period, from the marks before its first
    month and the movements of its months.
    """
    first, last = D.as_date(start), D.as_date(end) - dt.timedelta(days=1)
    months = (first.year * 100 + first.month, last.year * 100 + last.month)
    opening = marks(spark, root).filter(F.col("month") < months[0]).groupBy("product_id").agg(
        F.sum("moved").alias("opening_stock"))
    ledger = stored_ledger(spark, root, months)
    whole = kardex(Tables({"inventory_movements": ledger}), opening)
    at = F.col("moved_at")
    return whole.filter((at >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
                        & (at < F.lit(f"{D.as_date(end)} 00:00:00").cast("timestamp_ntz")))
