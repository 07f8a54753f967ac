"""Stock ledger: K1 kardex (running balances) and W9 movement application.

K1 is a prefix sum per product over range-partitioned rows: a product holding
a large share of all movements spreads over many partitions, each summed
locally plus what earlier partitions hold of that product.

W9 is order dependent: an EXIT is accepted only while the running stock
covers it, and a rejected EXIT leaves the stock unchanged, so the outcome of
one request depends on all decisions before it. Until a product's first
shortfall, though, every request is accepted and a running sum gives the
balances; products that never run short are decided so as a whole. Only what
comes from a first shortfall on is folded: per product in arrival order over
rows hash-partitioned by product and sorted inside each partition;
``mapInPandas`` streams those rows batch by batch with one (product, balance)
pair of state, so no product's requests are ever held in memory together.
Amounts are exact integer cents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal as D
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions.money import cents, from_cents
from millbook.functions.paging import dense_number
from millbook.functions.prefix import range_parts, running_sum, sums_over_parts
from millbook.plans.lineage import materialize, staged
from millbook.sources.schemas import ERP_SCHEMAS, MONEY
from millbook.sources.tables import Tables

ENTRY, EXIT = "ENTRY", "EXIT"
HOT_ROWS = 1 << 20  # requests for one product that one task sums; more are spread
LEDGER_ORDER = ("moved_at", "reference_id", "line_no", "quantity")


# --- K1 ------------------------------------------------------------------------------
def kardex(t: Tables, opening: DataFrame | None = None, order: tuple[str, ...] = LEDGER_ORDER) -> DataFrame:
    """Each movement with the product's balance before and after it.

    ``opening`` (product_id, opening_stock) sets the balance before the first
    movement (0 when absent). Movements are taken in ``order``, NULLs first;
    rows without a time or a product keep their place and balance. One
    range partitioning on (product, order) carries the running sum, so a
    product spreads over as many tasks as its movements need.
    """
    keep = dict.fromkeys(("product_id", "movement_type", "quantity", *order))
    out = running_sum(t.inventory_movements.select(*keep), list(order), "quantity", "_sum", group=["product_id"])
    start = F.lit(0)
    if opening is not None:
        known = opening.select(F.col("product_id").alias("_opened"), F.col("opening_stock").alias("_open"))
        out = out.join(known, F.col("product_id").eqNullSafe(F.col("_opened")), "left")
        start = F.coalesce(F.col("_open"), F.lit(0))
    closing = (start + F.col("_sum")).cast(T.DecimalType(18, 2))
    return out.select(
        "product_id", "movement_type", "quantity", *[c for c in order if c != "quantity"],
        (closing - F.col("quantity")).cast(T.DecimalType(18, 2)).alias("opening_balance"),
        closing.alias("closing_balance"))


def ledger_rows(movements: DataFrame, moved_at: Column, *also: str) -> DataFrame:
    """``movements`` in the stored ledger's columns (NULL where they have none), plus the columns ``also``.

    The ledger's ``id`` comes with the append (:func:`numbered_movements`).
    """
    kinds = {f.name: f.dataType for f in ERP_SCHEMAS["inventory_movements"].fields}
    have = movements.withColumn("moved_at", moved_at.cast(T.TimestampNTZType()))
    return have.select(*[(F.col(c) if c in have.columns else F.lit(None)).cast(kind).alias(c)
                         for c, kind in kinds.items() if c != "id"], *also)


def numbered_movements(t: Tables, movements: DataFrame) -> DataFrame:
    """``movements`` with ledger ids after the stored maximum, in order of all their columns."""
    top = t.inventory_movements.select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    keys = [c for c in ("moved_at", "reference_id", "line_no") if c in movements.columns]
    keys += [c for c in movements.columns if c not in keys]
    return dense_number(movements, keys, name="id", start=top + F.lit(1))


def ledger_balance(t: Tables) -> DataFrame:
    """Sum of the signed ledger per product (what the running balance ends at)."""
    return t.inventory_movements.groupBy("product_id").agg(
        F.sum("quantity").cast(T.DecimalType(18, 2)).alias("ledger_stock"))


# --- W9 ------------------------------------------------------------------------------
@dataclass
class MovementResult:
    decisions: DataFrame   # every valid request with accepted flag and balances
    movements: DataFrame   # accepted rows in the ledger's columns (signed quantity) + request_id, requested_at
    rejects: DataFrame     # request_id, product_id, reason
    stock: DataFrame       # products with the new current_stock


_FOLD_OUT = T.StructType([
    T.StructField("_accepted", T.BooleanType()),
    T.StructField("_before_c", T.LongType()),
    T.StructField("_after_c", T.LongType()),
])


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential accept/reject over rows sorted by (product, arrival)."""
    current, balance = None, 0
    for pdf in batches:
        pids = pdf["product_id"].tolist()
        qty = pdf["_q_c"].tolist()
        is_exit = pdf["_is_exit"].tolist()
        opening = pdf["_open_c"].tolist()
        n = len(pids)
        accepted, before, after = [False] * n, [0] * n, [0] * n
        for i in range(n):
            if pids[i] != current:
                current, balance = pids[i], opening[i]
            before[i] = balance
            if is_exit[i]:
                if balance >= qty[i]:
                    balance -= qty[i]
                    accepted[i] = True
            else:
                balance += qty[i]
                accepted[i] = True
            after[i] = balance
        yield pdf.assign(_accepted=accepted, _before_c=before, _after_c=after)


def fold_stock(requests: DataFrame, opening_cents: str, order: list[str],
               partitions: int | None = None, dealt: bool = False) -> DataFrame:
    """Run the per-product accept/reject fold.

    ``requests`` needs product_id, ``_q_c`` (positive cents), ``_is_exit`` and
    the opening balance in cents; ``order`` must make arrival order total
    within a product (ties between identical requests do not change results).
    ``dealt``: the rows are hash-partitioned by product already.
    """
    spark = requests.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    opened = requests.withColumn("_open_c", F.col(opening_cents))
    prepared = (opened if dealt else opened.repartition(n, "product_id")).sortWithinPartitions("product_id", *order)
    coded = {c: codes for c, kind in prepared.dtypes if (codes := _coded(c, kind)) is not None}
    plain = prepared.withColumns({c: there for c, (there, _) in coded.items()})
    folded = plain.mapInPandas(_fold_batches, T.StructType(plain.schema.fields + _FOLD_OUT.fields))
    return folded.withColumns({c: back for c, (_, back) in coded.items()})


def _coded(name: str, kind: str) -> tuple[Column, Column] | None:
    """An exact decimal or a date as a whole number, and that number as the column again; None for other types.

    Pandas holds decimals and dates as one Python object per value, which costs far more than the fold.
    """
    column = F.col(f"`{name}`")
    if kind == "date":
        return F.unix_date(column), F.date_from_unix_date(column)
    precision, scale = map(int, m.groups()) if (m := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)) else (38, 0)
    if precision > 17:
        return None
    tens, unit = D(10 ** scale), D(1).scaleb(-scale)
    whole = T.DecimalType(precision, 0)
    return ((column * F.lit(tens).cast(T.DecimalType(scale + 1, 0))).cast(T.LongType()),
            (column.cast(whole) * F.lit(unit).cast(T.DecimalType(scale + 1, scale))).cast(kind))


def _signed() -> Column:
    return F.when(F.col("_is_exit"), -F.col("_q_c")).otherwise(F.col("_q_c"))


def _falls_short() -> Column:
    return F.col("_is_exit") & (F.col("_before_c") < F.col("_q_c"))


def _balances_by_product(requests: DataFrame, opening_cents: str, order: list[str]) -> DataFrame:
    """Running balances with everything accepted, and each product's first shortfall: one shuffle by product."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrival = Window.partitionBy("product_id").orderBy(*order)
    moved = F.sum(_signed()).over(arrival.rowsBetween(Window.unboundedPreceding, 0))
    summed = (requests.repartition(n, "product_id").withColumn("_before_c", F.col(opening_cents) + moved - _signed())
              .withColumn("_nth", F.row_number().over(arrival)))
    short = F.min(F.when(_falls_short(), F.struct("_nth", "_before_c"))).over(Window.partitionBy("product_id"))
    return summed.withColumn("_short", short)


def _balances_by_range(requests: DataFrame, opening_cents: str, order: list[str]) -> DataFrame:
    """The same over range parts of (product, arrival): one product spreads over as many tasks as it needs."""
    parts = range_parts(requests, ["product_id", *order], "_range")
    summed = sums_over_parts(parts, "_range", ["product_id"], order, {"_moved": _signed(), "_nth": F.lit(1)})
    summed = staged(summed.withColumn("_before_c", F.col(opening_cents) + F.col("_moved") - _signed()), "balances")
    short = staged(summed.filter(_falls_short()).groupBy(F.col("product_id").alias("_short_id")).agg(
        F.min(F.struct("_nth", "_before_c")).alias("_short")), "shortfalls")
    return summed.join(short, F.col("product_id") == F.col("_short_id"), "left")


def decide_stock(requests: DataFrame, opening_cents: str, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Accept or reject every request against its product's running stock.

    Same columns in and out as :func:`fold_stock`. A running sum gives the balance
    with everything accepted; where an EXIT takes it below zero first, the
    product falls short, and its rows from there on go through the fold, which
    starts with the balance before that row. Products of up to ``hot_rows``
    requests are summed in one shuffle by product; larger ones in range parts of
    (product, arrival), so a product may hold any share of the rows.
    """
    hot = requests.groupBy(F.col("product_id").alias("_hot_id")).count().filter(F.col("count") > hot_rows).select("_hot_id")
    is_hot = F.col("product_id") == F.col("_hot_id")
    if hot.isEmpty():
        found = [_balances_by_product(requests, opening_cents, order)]
    else:
        hot = staged(hot, "hot-products")
        found = [_balances_by_product(requests.join(hot, is_hot, "left_anti"), opening_cents, order),
                 _balances_by_range(requests.join(hot, is_hot, "left_semi"), opening_cents, order)]
    late = F.col("_short").isNotNull() & (F.col("_nth") >= F.col("_short._nth"))
    decided = []
    for summed in found:
        decided.append(summed.filter(~late).select(*requests.columns, F.lit(True).alias("_accepted"), "_before_c",
                                                   (F.col("_before_c") + _signed()).alias("_after_c")))
        rest = summed.filter(late).select(*requests.columns, F.col("_short._before_c").alias("_left_c"))
        decided.append(fold_stock(rest, "_left_c", order, dealt=summed is found[0]).select(*decided[0].columns))
    return reduce(DataFrame.unionByName, decided)


def validate_movements(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W8 checks of movement requests: (valid with opening stock, rejects)."""
    prods = t.products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("_stock"),
                              F.lit(True).alias("_known"))
    r = requests.join(prods, "product_id", "left")
    reason = (F.when(F.col("_known").isNull(), F.lit("PRODUCT_NOT_FOUND"))
              .when(~F.col("movement_type").isin(ENTRY, EXIT) | F.col("movement_type").isNull(),
                    F.lit("INVALID_MOVEMENT_TYPE"))
              .when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit("NON_POSITIVE_QUANTITY")))
    r = r.withColumn("reason", reason)
    rejects = r.filter(F.col("reason").isNotNull()).select("request_id", "product_id", "reason")
    valid = r.filter(F.col("reason").isNull()).drop("reason", "_known")
    return valid, rejects


def apply_movements(t: Tables, requests: DataFrame,
                    order: tuple[str, ...] = ("requested_at", "request_id"),
                    checkpoint: bool = False) -> MovementResult:
    """Apply ENTRY/EXIT requests in arrival order per product.

    ENTRY adds its quantity; EXIT subtracts it, or is rejected with
    INSUFFICIENT_STOCK when the running stock is below it. Requests for
    unknown products, other types or quantities <= 0 are rejected first (W8).
    Movements carry the signed quantity (EXIT negative), as in the ledger.
    With ``checkpoint`` the decisions are checkpointed once for the four results.
    """
    valid, pre_rejects = validate_movements(t, requests)
    prepared = valid.select(
        *requests.columns,
        cents(F.col("quantity")).alias("_q_c"),
        (F.col("movement_type") == F.lit(EXIT)).alias("_is_exit"),
        cents(F.coalesce(F.col("_stock"), F.lit(0))).alias("_stock_c"))
    tie_break = [c for c in requests.columns if c not in order and c != "product_id"]
    decided = decide_stock(prepared, "_stock_c", [*order, *tie_break])
    base_cols = [c for c in requests.columns]
    decisions = decided.select(
        *base_cols, F.col("_accepted").alias("accepted"),
        from_cents("_before_c").alias("stock_before"), from_cents("_after_c").alias("stock_after"))
    if checkpoint:
        decisions = materialize(decisions)
    accepted = decisions.filter("accepted")
    signed = F.when(F.col("movement_type") == EXIT, -F.col("quantity")).otherwise(F.col("quantity"))
    movements = ledger_rows(
        accepted.select(*[c for c in base_cols if c != "quantity"], signed.cast(MONEY).alias("quantity"),
                        F.col("request_id").alias("reference_id")),
        F.col(order[0]), "request_id", *[c for c in ("requested_at",) if c in base_cols])
    stock_rejects = decisions.filter(~F.col("accepted")).select(
        "request_id", "product_id", F.lit("INSUFFICIENT_STOCK").alias("reason"))
    deltas = movements.groupBy("product_id").agg(F.sum("quantity").alias("_delta"))
    stock = (t.products.join(deltas, t.products["id"] == deltas["product_id"], "left")
             .withColumn("current_stock",
                         F.when(F.col("_delta").isNull(), F.col("current_stock"))
                         .otherwise((F.coalesce(F.col("current_stock"), F.lit(0)) + F.col("_delta")).cast(MONEY)))
             .select(*t.products.columns))
    return MovementResult(decisions, movements, pre_rejects.unionByName(stock_rejects), stock)
