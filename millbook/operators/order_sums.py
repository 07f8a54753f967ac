"""Sales reports from maintained sums: per (day, client, status), added to by every batch.

A batch of new orders adds one row per (day, client, status) it has; a batch of
status changes adds what it takes from the old statuses and gives to the new ones.
Rows merge by adding, so nothing is ever rewritten, and a report folds sums of a
size that follows days and clients instead of reading every order.

:func:`order_sums` has the columns of orders that A1-A4, A11 and A15 read, with
``orders`` for how many each row stands for: ``t.replace(sales_orders=...)`` runs
those reports on it as they are (A2 by the hour needs the orders themselves).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOTAL = T.DecimalType(28, 2)
_SCHEMA = (T.StructType().add("order_date", T.DateType()).add("client_id", T.LongType()).add("status", T.StringType())
           .add("total", _TOTAL).add("orders", T.LongType()))
_KEYS = ("order_date", "client_id", "status")


def _summed(rows: DataFrame, status: Column, sign: int) -> DataFrame:
    keyed = rows.select("order_date", "client_id", status.alias("status"), "total")
    return keyed.groupBy(*_KEYS).agg((F.sum("total") * sign).cast(_TOTAL).alias("total"),
                                     (F.count(F.lit(1)) * sign).alias("orders"))


def _add(sums: DataFrame, root: str, batch_id: str) -> None:
    """A batch's rows in a folder of its own, replaced when the batch runs again."""
    sums.select(*[F.col(f.name).cast(f.dataType) for f in _SCHEMA.fields]).write.mode("overwrite").parquet(
        os.path.join(root, f"load_id={batch_id}"))


def add_orders(orders: DataFrame, root: str, batch_id: str) -> None:
    """The sums of appended orders."""
    _add(_summed(orders, F.col("status"), 1), root, batch_id)


def move_orders(before: DataFrame, after: DataFrame, root: str, batch_id: str) -> None:
    """The corrections of a batch of status changes (W7): the orders before it and after it, by ``id``.

    Only orders whose status changed count, so ``before`` may be the whole table or just those the batch names.
    """
    now = after.select(F.col("id").alias("_id"), F.col("status").alias("_status"))
    moved = before.select("id", *_KEYS, "total").join(now, F.col("id") == F.col("_id")).filter(
        ~F.col("status").eqNullSafe(F.col("_status")))
    _add(_summed(moved, F.col("status"), -1).unionByName(_summed(moved, F.col("_status"), 1)), root, batch_id)


def order_sums(spark: SparkSession, root: str) -> DataFrame:
    """``order_date, client_id, status, total, orders``: all batches merged, groups that emptied left out."""
    parts = spark.read.schema(_SCHEMA).parquet(root)
    return (parts.groupBy(*_KEYS).agg(F.sum("total").alias("total"), F.sum("orders").alias("orders"))
            .filter(F.col("orders") != 0))
