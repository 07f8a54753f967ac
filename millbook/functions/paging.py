"""Pages of a sorted listing with totals, and distributed dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.plans.lineage import staged


def page_bounds(page, limit, default_limit: int = 10) -> tuple[int, int, int]:
    """(page, limit, offset): page defaults to 1 and is clamped to >= 1."""
    try:
        page = int(page)
    except (TypeError, ValueError):
        page = 1
    try:
        limit = int(limit)
    except (TypeError, ValueError):
        limit = default_limit
    page = max(page, 1)
    limit = limit if limit > 0 else default_limit
    return page, limit, (page - 1) * limit


#: Rows up to a page's end that a top-k may keep per task; deeper pages go by order statistics.
SHALLOW = 1_000


def deep_rows(df: DataFrame, keys: list[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    """(rows ``offset`` to ``offset + limit`` of ``df`` sorted by ``keys``, number of all rows).

    The rows are staged in range parts of ``keys``. The parts' counts tell which
    parts the page lies in; only those are read and sorted, so a page costs the
    same at any depth, and no task keeps the rows before it.
    """
    part = "_page_part"
    while part in df.columns:
        part += "_"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), "pages", by=part)
    counts = sorted((r[part], r["count"]) for r in rows.groupBy(part).count().collect())  # one row per range part
    own, skipped, before = [], 0, 0
    for number, count in counts:
        if before + count <= offset:
            skipped += count
        elif before < offset + limit:
            own.append(number)
        before += count
    page = rows.filter(F.col(part).isin(own)).drop(part).orderBy(*keys).offset(offset - skipped).limit(limit)
    return page, before


def page_with_totals(df: DataFrame, keys: list[Column], page=1, limit=None,
                     default_limit: int = 10) -> DataFrame:
    """One page of ``df`` sorted by ``keys`` plus ``total_items``, ``total_pages``, ``current_page``.

    ``keys`` must make the order total (end them with a unique column). A page
    that ends within ``SHALLOW`` rows is ``orderBy().offset().limit()``, a
    distributed top-(offset+limit) (``TakeOrderedAndProject``), and the total a
    scalar subquery over the same frame, so no cartesian product is formed. A
    deeper one comes from :func:`deep_rows`.
    """
    page, limit, offset = page_bounds(page, limit, default_limit)
    if offset + limit > SHALLOW:
        rows, counted = deep_rows(df, keys, offset, limit)
        total = F.lit(counted).cast(T.LongType())
    else:
        total = df.select(F.count(F.lit(1)).alias("n")).scalar()
        rows = df.orderBy(*keys).offset(offset).limit(limit)
    return (rows.select("*", total.alias("total_items"))
            .withColumn("total_pages",
                        F.ceil(F.col("total_items").cast(T.DoubleType()) / F.lit(float(limit))).cast(T.LongType()))
            .withColumn("current_page", F.lit(page).cast(T.IntegerType())))


def dense_number(df: DataFrame, keys: list[str], name: str = "seq", start: Column | int = 1,
                 partitions: int | None = None) -> DataFrame:
    """Number rows 1..n (plus ``start - 1``) in the total order of ``keys``, without one task.

    Range-partition on ``keys`` and sort inside each partition; then
    ``monotonically_increasing_id()`` is (partition << 33) + position in the
    sorted partition, so the local number costs one projection and no second
    shuffle. The row count of every earlier partition is added from a frame
    with one row per partition (a fixed bound, so it is broadcast). ``keys``
    must be unique for the numbering to be deterministic.

    The numbered partitions are staged in the shared folder whatever the
    session's settings (:func:`millbook.plans.lineage.staged`): the counts and
    the rows come from one range exchange, because two exchanges would sample
    their bounds separately and place rows differently.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_mid"), 33))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1), "numbered")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_part",
        (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local") + start_col - 1)
                        .cast(T.LongType()))
            .drop("_mid", "_part", "_local", "_before"))
