"""Running sums and dense numbers over a total order, without one task per group.

A group may hold any share of the rows. The rows are range-partitioned on
(group, order), so a large group spreads over as many partitions as its size
asks for; each partition sums locally and adds what earlier partitions hold
of the same group. The range-partitioned rows are staged first: the totals and
the rows then come from one exchange, and two exchanges never sample different
bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millbook.plans.lineage import staged


def running_sum(df: DataFrame, order: list[str], value: str, name: str, group: list[str] = (),
                partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over the rows up to and including this one.

    The order is ``group + order`` ascending, nulls first; it must be total for
    the result to be deterministic (rows equal in every order column may swap).
    ``value`` must be an integer column for exact sums. Only two frames are
    grouped: the rows by (partition, group), bounded by a range partition, and
    one row per (partition, group), which is windowed per group.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    rows, keys = _group_keys(staged(df.repartitionByRange(n, *[F.col(c) for c in group + list(order)])
                                    .withColumn("_part", F.spark_partition_id()), "range"), group)
    totals = rows.groupBy("_part", *keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys or [F.lit(1)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_at"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)],
                            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside))
    return local.join(offsets, _same_group(keys, "_part"), "left").select(
        *df.columns, (F.col("_before") + F.col("_local")).alias(name))


def _group_keys(rows: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with columns that are equal where the group is, a NULL equal to a NULL, and never NULL; and their names.

    A plain join on them takes the rows as their window left them, partitioned and
    sorted; a null-safe one would shuffle and sort all of them a second time.
    """
    kinds, added, keys = dict(rows.dtypes), {}, []
    for i, c in enumerate(group):
        zero = F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c]) if kinds[c] in _NUMBERS else None
        if zero is None:  # no value of its type to stand for NULL: its text does
            added[f"_k{i}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
        else:
            added[f"_k{i}"] = F.coalesce(F.col(c), zero)
        added[f"_n{i}"] = F.col(c).isNull()
        keys += [f"_k{i}", f"_n{i}"]
    return rows.withColumns(added) if added else rows, keys


_NUMBERS = {"tinyint", "smallint", "int", "bigint"}


def _same_group(keys: list[str], part: str) -> Column:
    cond = F.col(part) == F.col("_at")
    for i, c in enumerate(keys):
        cond = cond & (F.col(c) == F.col(f"_g{i}"))
    return cond


def range_parts(df: DataFrame, order: list[str], part: str, partitions: int | None = None) -> DataFrame:
    """``df`` staged in range partitions of ``order`` (nulls first), their numbers in column ``part``.

    What :func:`sums_over_parts` works on, any number of times.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()), "range")


def sums_over_parts(rows: DataFrame, part: str, group: list[str], order: list[str], values: dict[str, Column],
                    inclusive: bool = True) -> DataFrame:
    """``rows`` plus, per name in ``values``, the sum of that column over the group's rows up to this one.

    ``rows`` come from :func:`range_parts` of ``group + order`` (some may be gone
    and columns added since). Without ``inclusive`` the row itself is left out. Two
    frames are grouped: the rows of a group in one part, and one row per (part, group).
    """
    names = list(values)
    valued, keys = _group_keys(rows.withColumns({f"_v_{n}": c for n, c in values.items()}), group)
    totals = valued.groupBy(part, *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys or [F.lit(1)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("_at"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)],
                            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = valued.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    return local.join(offsets, _same_group(keys, part), "left").select(
        *rows.columns, *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in names])
