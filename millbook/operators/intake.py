"""Order and production intake W10-W14.

Sales-order requests are a header frame (request_id, requested_at,
client_id, user_id, notes, delivery_date) and a line frame (request_id,
line_no, product_id, quantity, price). All checks of a batch read the
opening snapshot; new orders carry no invoice, so one order's credit check
never depends on another order of the same batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions import dates as D
from millbook.functions.money import cents
from millbook.functions.prefix import range_parts, sums_over_parts
from millbook.operators import reports as R
from millbook.operators.changes import ARRIVAL, _next_ids, _now, reject_duplicate_key, reject_missing
from millbook.operators.ledger import EXIT, apply_movements, fold_stock, ledger_rows, validate_movements
from millbook.plans.lineage import materialize, staged
from millbook.sources.schemas import MONEY, WIDE_MONEY
from millbook.sources.tables import Tables

TAX_RATE = "0.16"  # fixed value: sales tax applied to every order subtotal
# The reference texts of production movements.
CONSUMPTION_TEXT, PRODUCTION_TEXT, BATCH_TEXT = "Consumo OP: ", "Producción OP: ", " / Lote: "


# --- W10 -------------------------------------------------------------------------------
def _priced(per_request: DataFrame, *also: str) -> DataFrame:
    """Subtotal, tax and total from ``subtotal_exact``, exact and as stored."""
    tax = F.col("subtotal_exact") * F.lit(TAX_RATE).cast(T.DecimalType(4, 2))
    return per_request.select(
        "request_id", "subtotal_exact", tax.alias("tax_exact"),
        (F.col("subtotal_exact") + tax).alias("total_exact"),
        F.col("subtotal_exact").cast(WIDE_MONEY).alias("subtotal"),
        tax.cast(WIDE_MONEY).alias("tax_amount"),
        (F.col("subtotal_exact") + tax).cast(WIDE_MONEY).alias("total"), *also)


def price_sales_orders(lines: DataFrame) -> DataFrame:
    """Per request, subtotal = sum(quantity x request price), tax 16 %, total.

    ``*_exact`` columns keep every digit (the credit check uses them);
    ``subtotal``, ``tax_amount``, ``total`` are rounded half-up to cents as stored.
    """
    return _priced(lines.groupBy("request_id").agg(F.sum(F.col("quantity") * F.col("price")).alias("subtotal_exact")))


# --- W11 -------------------------------------------------------------------------------
def check_sales_orders(t: Tables, headers: DataFrame, lines: DataFrame) -> DataFrame:
    """The first failing check per request, in the reference's order, or NULL.

    EMPTY_ORDER (no lines) -> CLIENT_NOT_FOUND -> CREDIT_LIMIT_EXCEEDED
    (open balance + new total > credit limit, strict; a NULL limit never
    fails) -> per line in line order: PRODUCT_NOT_FOUND or INSUFFICIENT_STOCK
    (current stock, 0 when NULL, < line quantity; each line checks the opening stock).
    """
    return _checked(t, headers, lines).drop("_unknown")


def _checked(t: Tables, headers: DataFrame, lines: DataFrame) -> DataFrame:
    """W11 with ``_unknown``: some line names an unknown product. One pass over the lines."""
    balance = R.client_outstanding_balance(t, clients=headers.select("client_id")).select(
        "client_id", "credit_limit", F.col("outstanding_balance").alias("_open"), F.lit(True).alias("_client"))
    prods = t.products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("_stock"),
                              F.lit(True).alias("_known"))
    failing = (F.when(F.col("_known").isNull(), F.lit("PRODUCT_NOT_FOUND"))
               .when(F.coalesce(F.col("_stock"), F.lit(0)) < F.col("quantity"), F.lit("INSUFFICIENT_STOCK")))
    per_request = (lines.join(prods, "product_id", "left").withColumn("_r", failing)
                   .groupBy("request_id")
                   .agg(F.sum(F.col("quantity") * F.col("price")).alias("subtotal_exact"),
                        F.min_by(F.col("_r"), F.when(F.col("_r").isNotNull(),
                                                     F.struct("line_no", "product_id", "quantity", "price")))
                        .alias("_line_r"),
                        F.bool_or(F.col("_known").isNull()).alias("_unknown")))
    h = (headers.join(_priced(per_request, "_line_r", "_unknown"), "request_id", "left")
         .join(balance, "client_id", "left"))
    over = (F.col("_open") + F.col("total_exact")) > F.col("credit_limit")
    reason = (F.when(F.col("total_exact").isNull(), F.lit("EMPTY_ORDER"))
              .when(F.col("_client").isNull(), F.lit("CLIENT_NOT_FOUND"))
              .when(F.coalesce(over, F.lit(False)), F.lit("CREDIT_LIMIT_EXCEEDED"))
              .otherwise(F.col("_line_r")))
    return h.select(*headers.columns, "subtotal", "tax_amount", "total", "total_exact", reason.alias("reason"), "_unknown")


# --- W12 -------------------------------------------------------------------------------
@dataclass
class IntakeResult:
    sales_orders: DataFrame    # appended order headers
    order_products: DataFrame  # appended lines
    movements: DataFrame       # EXIT ledger rows, one per accepted line
    stock: DataFrame           # products with the new current_stock
    rejects: DataFrame         # request_id, reason
    rounds: int | None = None  # rounds of reservations that ``exact`` took


def _header_ok() -> Column:
    """Nothing but a line can have failed."""
    return F.col("reason").isNull() | F.col("reason").isin("PRODUCT_NOT_FOUND", "INSUFFICIENT_STOCK")


def _reservations(t: Tables, checked: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per (order, product) of the orders whose header passes, in cents: what it needs in all and per line.

    Range parts of (product, arrival). ``state``: None while undecided, False for
    an order that names an unknown product, which can never take anything.
    """
    orders = checked.filter(_header_ok()).select(*ARRIVAL, F.coalesce("_unknown", F.lit(False)).alias("_unknown"))
    prods = t.products.select(F.col("id").alias("product_id"), cents(F.coalesce("current_stock", F.lit(0))).alias("stock_c"))
    needs = (lines.join(orders, "request_id").groupBy(*ARRIVAL, "product_id", "_unknown").agg(
        F.coalesce(F.sum(cents("quantity")), F.lit(0)).alias("need_c"), F.max(cents("quantity")).alias("most_c"))
        .join(prods, "product_id"))
    return range_parts(needs.select(*ARRIVAL, "product_id", "need_c", "most_c", "stock_c",
                                    F.when(F.col("_unknown"), False).alias("state")),
                       ["product_id", *ARRIVAL], "_range")


def _stock_before(rows: DataFrame, low: str, high: str) -> DataFrame:
    """``rows`` with the least and the most stock that earlier orders can leave each (equal once those are decided)."""
    undecided, taken = F.col("state").isNull(), F.coalesce(F.col("state"), F.lit(False))
    none = F.lit(0).cast("long")
    values = {low: F.when(taken, F.col("need_c")).when(undecided, F.greatest("need_c", none)).otherwise(none),
              high: F.when(taken, F.col("need_c")).when(undecided, F.least("need_c", none)).otherwise(none)}
    summed = sums_over_parts(rows, "_range", ["product_id"], list(ARRIVAL), values, inclusive=False)
    return summed.withColumns({low: F.col("stock_c") - F.col(low), high: F.col("stock_c") - F.col(high)})


def reserve_in_rounds(claims: DataFrame) -> tuple[DataFrame, int]:
    """(``request_id, accepted`` per order, rounds): orders decided as if one at a time, in arrival order.

    Every order reserves its products by arrival. What the undecided orders before
    it may still take bounds the stock it will meet: an order is accepted if even
    the least stock covers every line, rejected if even the most does not cover
    one. In each round the first undecided order knows its stock exactly, so a
    round decides at least that one, and as a rule all whose products are not
    contested that closely; rejected orders release their reservations and only
    products some undecided order still wants go into the next round.
    """
    decided, live, rounds = [], claims, 0
    while True:
        bounds = _stock_before(live, "_low", "_high").filter(F.col("state").isNull())
        order = bounds.groupBy("request_id").agg(
            F.bool_or(F.coalesce(F.col("most_c") > F.col("_high"), F.lit(False))).alias("_fails"),
            F.bool_and(F.coalesce(F.col("most_c") <= F.col("_low"), F.lit(True))).alias("_holds"))
        verdicts = staged(order.filter(F.col("_fails") | F.col("_holds")).select(
            "request_id", (~F.col("_fails")).alias("accepted")), "verdicts")
        if verdicts.isEmpty():
            return decided[0] if decided else verdicts, rounds
        rounds += 1
        decided = [decided[0].unionByName(verdicts)] if decided else [verdicts]
        known = verdicts.select(F.col("request_id").alias("_rid"), "accepted")
        told = staged(live.join(known, F.col("request_id") == F.col("_rid"), "left")
                      .withColumn("state", F.coalesce("state", "accepted")).drop("_rid", "accepted")
                      .filter(F.col("state").isNull() | F.col("state")), "reservations")
        wanted = staged(told.filter(F.col("state").isNull()).select(F.col("product_id").alias("_pid")).distinct(), "wanted")
        live = told.join(wanted, F.col("product_id") == F.col("_pid"), "left_semi")


def _exact(t: Tables, checked: DataFrame, lines: DataFrame) -> tuple[DataFrame, int]:
    """Re-decide line checks as the reference does, one order after the other: (``checked`` with reasons, rounds).

    A line is checked against what the accepted orders before left of its
    product (its own order's other lines have not been taken yet), in line order;
    the first that fails gives the reason.
    """
    claims = _reservations(t, checked, lines)
    verdicts, rounds = reserve_in_rounds(claims)
    known = verdicts.select(F.col("request_id").alias("_rid"), F.col("accepted").alias("_accepted"))
    final = claims.join(known, F.col("request_id") == F.col("_rid"), "left").withColumn(
        "state", F.coalesce("state", "_accepted")).drop("_rid", "_accepted")
    met = _stock_before(final, "_met", "_same").select(F.col("request_id").alias("_rid"), F.col("product_id").alias("_pid"), "_met")
    orders = checked.filter(_header_ok()).select(F.col("request_id").alias("_oid"))
    own = lines.join(orders, F.col("request_id") == F.col("_oid"), "left_semi").join(
        met, (F.col("request_id") == F.col("_rid")) & (F.col("product_id") == F.col("_pid")), "left")
    failing = F.when(F.col("_rid").isNull(), F.lit("PRODUCT_NOT_FOUND")).when(
        cents("quantity") > F.col("_met"), F.lit("INSUFFICIENT_STOCK"))
    first = own.withColumn("_r", failing).groupBy(F.col("request_id").alias("_oid")).agg(
        F.min_by("_r", F.when(F.col("_r").isNotNull(), F.struct("line_no", "product_id", "quantity", "price"))).alias("_line_r"))
    reason = F.when(_header_ok(), F.col("_line_r")).otherwise(F.col("reason"))
    return checked.join(first, F.col("request_id") == F.col("_oid"), "left").withColumn("reason", reason).drop("_line_r", "_oid"), rounds


def _allocate(t: Tables, checked: DataFrame, lines: DataFrame) -> DataFrame:
    """Re-decide line checks with stock claimed in arrival order.

    Requests failing a header check (EMPTY_ORDER, CLIENT_NOT_FOUND,
    CREDIT_LIMIT_EXCEEDED) keep that reason; a request with any line of an
    unknown product gets PRODUCT_NOT_FOUND. The lines of the remaining
    requests claim stock per product in arrival order (the W9 fold, EXIT
    only); a request is accepted when every line got its stock, else
    INSUFFICIENT_STOCK. A line of a request that another of its lines sinks
    still holds its claim inside the batch, so later requests see less stock
    than the final outcome leaves: conservative, never oversells.
    """
    line_reasons = ("PRODUCT_NOT_FOUND", "INSUFFICIENT_STOCK")
    header_failed = F.col("reason").isNotNull() & ~F.col("reason").isin(*line_reasons)
    unknown = F.coalesce(F.col("_unknown"), F.lit(False))
    candidates = checked.filter(~header_failed & ~unknown).select(*ARRIVAL)
    prods = t.products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("_stock"))
    claims = lines.join(candidates, "request_id").join(prods, "product_id").select(
        "request_id", "requested_at", "line_no", "product_id", "quantity", "price",
        cents("quantity").alias("_q_c"), F.lit(True).alias("_is_exit"),
        cents(F.coalesce(F.col("_stock"), F.lit(0))).alias("_stock_c"))
    folded = fold_stock(claims, "_stock_c", ["requested_at", "request_id", "line_no", "quantity", "price"])
    sunk = folded.groupBy("request_id").agg(F.bool_or(~F.col("_accepted")).alias("_sunk"))
    reason = (F.when(header_failed, F.col("reason"))
              .when(unknown, F.lit("PRODUCT_NOT_FOUND"))
              .when(F.col("_sunk"), F.lit("INSUFFICIENT_STOCK")))
    return checked.join(sunk, "request_id", "left").withColumn("reason", reason).drop("_sunk")


def intake_sales_orders(t: Tables, headers: DataFrame, lines: DataFrame, as_of,
                        mode: str = "allocate", checkpoint: bool = False) -> IntakeResult:
    """Accepted requests become QUOTE orders, their lines, EXIT movements and less stock.

    ``mode='allocate'`` claims stock per product in arrival order (see
    :func:`_allocate`) and never oversells; ``'exact'`` decides as one order after
    the other would (see :func:`reserve_in_rounds`), so a rejected order's stock is
    free for the next; ``'snapshot'`` checks every order against the opening stock
    only, so a batch may oversell a product that several orders want.
    Ids continue after the stored maximum in arrival order; numbers are
    ``SO-yyyymmdd-id`` of ``as_of``, which is also the order date. With
    ``checkpoint`` the numbered decisions are checkpointed once, so the four
    outputs do not each recompute the checks.
    """
    checked, rounds = _checked(t, headers, lines), None
    if mode == "allocate":
        checked = _allocate(t, materialize(checked), lines)  # decided once for the claims and the result
    elif mode == "exact":
        checked, rounds = _exact(t, materialize(checked), lines)
        checkpoint = True  # the numbering and every output would each go back to the reservations
    elif mode != "snapshot":
        raise ValueError(f"unknown mode {mode!r}")
    if checkpoint:
        checked = materialize(checked)
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    accepted = checked.filter(F.col("reason").isNull())
    numbered = _next_ids(t.sales_orders, accepted, keys=(*ARRIVAL, *[c for c in headers.columns if c not in ARRIVAL]))
    stamp = D.as_date(as_of).strftime("%Y%m%d")
    orders = numbered.select(
        "id", F.concat(F.lit(f"SO-{stamp}-"), F.col("id").cast(T.StringType())).alias("order_number"),
        "client_id", F.lit(D.as_date(as_of)).alias("order_date"),
        F.col("subtotal").cast(MONEY).alias("subtotal"), F.col("tax_amount").cast(MONEY).alias("tax_amount"),
        F.col("total").cast(MONEY).alias("total"), "notes", F.col("user_id").alias("created_by"),
        F.lit("QUOTE").alias("status"), "delivery_date", *ARRIVAL)
    keyed = orders.select(F.col("request_id"), F.col("id").alias("order_id"), "order_number", "created_by")
    acc_lines = lines.join(keyed, "request_id")
    order_products = acc_lines.select("order_id", "product_id", "quantity", "price")
    movements = ledger_rows(acc_lines.select(
        "product_id", F.lit(EXIT).alias("movement_type"), (-F.col("quantity")).cast(MONEY).alias("quantity"),
        F.col("created_by").alias("user_id"), F.col("order_number").alias("reference_document"),
        F.col("order_id").alias("reference_id"), "line_no"), _now(as_of))
    taken = acc_lines.groupBy("product_id").agg(F.sum("quantity").alias("_taken"))
    stock = (t.products.join(taken, t.products["id"] == taken["product_id"], "left")
             .withColumn("current_stock", F.when(F.col("_taken").isNull(), F.col("current_stock"))
                         .otherwise((F.coalesce(F.col("current_stock"), F.lit(0)) - F.col("_taken")).cast(MONEY)))
             .select(*t.products.columns))
    return IntakeResult(orders, order_products, movements, stock, rejects, rounds)


# --- W13 -------------------------------------------------------------------------------
@dataclass
class ProductionIntake:
    rows: DataFrame       # production_consumptions or production_batches rows
    movements: DataFrame  # ledger rows
    rejects: DataFrame    # request_id, reason


def consumption_movements(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consumption requests as EXIT movement requests ('Consumo OP: <number>'), plus
    ORDER_NOT_FOUND rejects. The order id rides along with each movement."""
    po = t.production_orders.select(F.col("id").alias("order_id"), "order_number")
    j = requests.join(po, "order_id", "left")
    rejects = j.filter(F.col("order_number").isNull()).select("request_id", F.lit("ORDER_NOT_FOUND").alias("reason"))
    mv = j.filter(F.col("order_number").isNotNull()).select(
        "request_id", "requested_at", F.col("material_id").alias("product_id"),
        F.lit(EXIT).alias("movement_type"), F.col("consumed_quantity").alias("quantity"), "user_id",
        F.concat(F.lit(CONSUMPTION_TEXT), F.col("order_number")).alias("reference_document"), "order_id")
    return mv, rejects


def intake_consumptions(t: Tables, requests: DataFrame, as_of) -> ProductionIntake:
    """Consumptions of any existing production order, each an EXIT through W9.

    Accepted requests become production_consumptions rows (date = now) and
    ledger rows; the rest are rejected with the W8/W9 reason.
    """
    mv, rejects = consumption_movements(t, requests)
    result = apply_movements(t, mv)
    rows = result.decisions.filter("accepted").select(
        "order_id", F.col("product_id").alias("material_id"), F.col("quantity").alias("consumed_quantity"),
        _now(as_of).alias("date"), "request_id")
    all_rejects = rejects.unionByName(result.rejects.select("request_id", "reason"))
    return ProductionIntake(rows, result.movements, all_rejects)


# --- W14 -------------------------------------------------------------------------------
def intake_batches(t: Tables, requests: DataFrame, as_of) -> ProductionIntake:
    """Finished batches: the order must exist, the batch number be given, the
    order's product exist and the produced quantity be positive; of the requests
    that pass, the batch number must be new (not stored, nor an earlier one's).
    Accepted requests become production_batches rows (quality RELEASED and date now unless given) and ENTRY movements of
    the order's product carrying the batch number. The produced quantity
    exists only in the movement."""
    po = t.production_orders.select(F.col("id").alias("order_id"), "order_number", "product_id")
    j = requests.join(po, "order_id", "left")
    no_order = j.filter(F.col("order_number").isNull()).select("request_id", F.lit("ORDER_NOT_FOUND").alias("reason"))
    found = j.filter(F.col("order_number").isNotNull())
    named, unnamed = reject_missing(found, "batch_number")
    mv_req = named.select(
        "request_id", "requested_at", "product_id", F.lit("ENTRY").alias("movement_type"),
        F.col("quantity_produced").alias("quantity"), "user_id",
        F.concat(F.lit(PRODUCTION_TEXT), F.col("order_number"), F.lit(BATCH_TEXT), F.col("batch_number"))
        .alias("reference_document"), F.col("batch_number").alias("batch"),
        "order_id", "production_date", "quality")
    valid, bad = validate_movements(t, mv_req)
    ok, dup = reject_duplicate_key(valid.withColumnRenamed("batch", "batch_number"), "batch_number",
                                   t.production_batches, "DUPLICATE_BATCH_NUMBER")
    ok = ok.withColumnRenamed("batch_number", "batch")
    rows = ok.select(
        F.col("batch").alias("batch_number"), "order_id",
        F.coalesce(F.col("production_date"), _now(as_of)).alias("production_date"),
        F.coalesce(F.nullif(F.col("quality"), F.lit("")), F.lit("RELEASED")).alias("quality"), "request_id")
    movements = ledger_rows(ok.withColumn("reference_id", F.col("request_id")),
                            F.coalesce(F.col("production_date"), _now(as_of)), "request_id")
    rejects = (no_order.unionByName(unnamed).unionByName(bad.select("request_id", "reason"))
               .unionByName(dup.select("request_id", "reason")))
    return ProductionIntake(rows, movements, rejects)
