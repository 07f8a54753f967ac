"""Aggregated reports A1-A16 (sales, production cost, profit, payroll, dashboards).

Shape of every report: filter at the scan, aggregate the fact table on its
own key first (partial aggregation before the shuffle), then join the
already-small result to its dimension. Money stays decimal end to end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions import dates as D
from millbook.functions.filters import active, apply_filters, bound, equals
from millbook.functions.money import quotient, sum_money, to_fixed, wide, zero
from millbook.functions.ordering import asc, desc
from millbook.sources.schemas import MONEY, WIDE_MONEY
from millbook.sources.tables import Tables

# Fixed values of the reports (they must equal the reference's for equal results):
# statuses read, waste cost per kg (cost analysis), one hour's share of a monthly
# salary (1 / 160), overtime pay factor and hours deducted per absence.
COMPLETED = "COMPLETED"
OPEN_INVOICE = ("PENDING", "OVERDUE")
WASTE_COST_PER_KG = 25.0
PER_HOUR = Decimal("0.00625")
OVERTIME_FACTOR = 2
ABSENCE_HOURS = 8


def _completed(t: Tables) -> DataFrame:
    return t.sales_orders.filter(F.col("status") == F.lit(COMPLETED))


def _order_count(so: DataFrame) -> Column:
    """Orders of a group; rows of maintained sums (``order_sums``) stand for several."""
    return F.sum("orders") if "orders" in so.columns else F.count("id")


# --- A1 ---------------------------------------------------------------------------
def sales_by_client(t: Tables, start=None, end=None) -> DataFrame:
    """A1: COMPLETED orders per client (count, total) in an optional inclusive date range.

    Clients without such orders are absent; inactive clients are included.
    """
    so = apply_filters(_completed(t), bound("order_date", start, end))
    per_client = so.groupBy("client_id").agg(
        _order_count(so).alias("total_orders"), sum_money("total").alias("total_sales"))
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (per_client.join(clients, "client_id")
            .select("client_id", "client_name", "total_orders", "total_sales")
            .orderBy(desc("total_sales"), asc("client_id")))


# --- A2 / A3 / A4 -------------------------------------------------------------------
def _dashboard_orders(t: Tables, as_of, period=None, client_id=None, start=None, end=None,
                      with_client: bool = True) -> tuple[DataFrame, object]:
    cond, bucket = D.period_plan(period, as_of, start, end)
    so = _completed(t).filter(cond)
    if with_client:
        so = apply_filters(so, equals("client_id", client_id))
    return so, bucket


def sales_over_time(t: Tables, as_of, period=None, client_id=None, start=None, end=None) -> DataFrame:
    """A2: COMPLETED sales per time bucket, ascending; buckets without sales are absent."""
    so, bucket = _dashboard_orders(t, as_of, period, client_id, start, end)
    return (so.groupBy(bucket.alias("date")).agg(sum_money("total").alias("total_sales"))
            .orderBy(asc("date")))


def sales_kpis(t: Tables, as_of, period=None, client_id=None, start=None, end=None) -> DataFrame:
    """A3: revenue, order count and average ticket (decimal, 6 places) over the dashboard filter (one row)."""
    so, _ = _dashboard_orders(t, as_of, period, client_id, start, end)
    agg = so.agg(F.sum("total").alias("_sum"), F.coalesce(_order_count(so), F.lit(0)).alias("total_orders"))
    return agg.select(
        wide("_sum").alias("total_revenue"),
        "total_orders",
        quotient("_sum", "total_orders", 6).alias("average_order_value"))


def _top_client_names(so: DataFrame, t: Tables, k: int = 5) -> DataFrame:
    per_client = so.groupBy("client_id").agg(F.sum("total").alias("_s"))
    named = per_client.join(t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")),
                            "client_id")
    return (named.groupBy("client_name").agg(sum_money("_s").alias("total_sales"))
            .orderBy(desc("total_sales"), asc("client_name")).limit(k))


def top_clients(t: Tables, as_of, period=None, client_id=None, start=None, end=None, k: int = 5) -> DataFrame:
    """A4: top clients by name over the dashboard date filter; the client filter is ignored."""
    so, _ = _dashboard_orders(t, as_of, period, None, start, end, with_client=False)
    return _top_client_names(so, t, k)


# --- A5 -----------------------------------------------------------------------------
def waste_by_process(t: Tables, start=None, end=None) -> DataFrame:
    """A5: waste quantity per process (date bounds are midnights on a timestamp column)."""
    w = apply_filters(t.wastes, bound("date", start, end))
    return (w.groupBy("process").agg(sum_money("quantity").alias("total_waste"))
            .orderBy(desc("total_waste"), asc("process")))


# --- A6 -----------------------------------------------------------------------------
def _order_costs(t: Tables, order_ids: DataFrame | None) -> DataFrame:
    """Production orders (with their product) and, where there are any, ``_mat`` and ``_waste_kg``."""
    po = t.production_orders
    if order_ids is not None:
        po = po.join(order_ids.select(F.col(order_ids.columns[0]).alias("id")), "id", "left_semi")
    prices = t.products.select(F.col("id").alias("material_id"), "cost_price")
    material = (t.production_consumptions.join(prices, "material_id")
                .groupBy("order_id").agg(F.sum(F.col("consumed_quantity") * F.col("cost_price")).alias("_mat")))
    waste = t.wastes.groupBy("order_id").agg(F.sum("quantity").alias("_waste_kg"))
    head = po.join(t.products.select(F.col("id").alias("product_id"), F.col("cost_price").alias("product_cost")),
                   "product_id")
    return (head.join(material, head["id"] == material["order_id"], "left").drop("order_id")
            .join(waste, head["id"] == waste["order_id"], "left").drop("order_id"))


def production_cost_analysis(t: Tables, order_ids: DataFrame | None = None,
                             waste_cost_per_kg: float = WASTE_COST_PER_KG) -> DataFrame:
    """Material, waste, labor (0) and total cost per production order, all orders in one pass.

    Consumptions and wastes are aggregated by order separately before the
    join (joining raw rows would multiply them). Material is valued at the
    material's current ``cost_price``; the order must have its product.
    ``cost_per_unit`` divides by the planned quantity, to 2 places, and is NULL when it is 0.
    """
    out = _order_costs(t, order_ids)
    rate = F.lit(str(waste_cost_per_kg)).cast(T.DecimalType(10, 2))
    material_cost = wide(F.coalesce(F.col("_mat"), F.lit(0)))
    waste_cost = wide(F.coalesce(F.col("_waste_kg"), F.lit(0)) * rate)
    total = wide(material_cost + waste_cost)
    return out.select(
        F.col("id").alias("order_id"), "order_number", "product_id",
        F.col("quantity").alias("quantity_produced"),
        F.col("product_cost").alias("manufactured_product_cost_estimate"),
        material_cost.alias("material_cost"),
        zero().alias("labor_cost"),
        waste_cost.alias("waste_cost"),
        total.alias("total_cost"),
        quotient(total, "quantity", 2).alias("cost_per_unit"))


def production_cost_texts(t: Tables, order_ids: DataFrame | None = None,
                          waste_cost_per_kg: float = WASTE_COST_PER_KG) -> DataFrame:
    """A6 as the endpoint answers it: sums and quotient in doubles, each amount a ``toFixed(2)`` text.

    A planned quantity of 0 (or none) gives "Infinity" per unit, or "NaN" where there is no cost either.
    """
    out = _order_costs(t, order_ids)
    zero_double = F.lit(0.0)
    material = F.coalesce(F.col("_mat").cast("double"), zero_double)
    waste = F.coalesce(F.col("_waste_kg").cast("double"), zero_double) * F.lit(float(waste_cost_per_kg))
    total, planned = material + waste, F.coalesce(F.col("quantity").cast("double"), zero_double)
    unit = (F.when(planned != 0, F.try_divide(total, planned)).when(total > 0, F.lit(float("inf")))
            .otherwise(F.lit(float("nan"))))
    return out.select(
        F.col("id").alias("order_id"), "order_number", "product_id", F.col("quantity").alias("quantity_produced"),
        to_fixed(material).alias("material_cost"), to_fixed(zero_double).alias("labor_cost"), to_fixed(waste).alias("waste_cost"),
        to_fixed(total).alias("total_cost"), to_fixed(unit).alias("cost_per_unit"))


# --- A8 / A7 ------------------------------------------------------------------------
def latest_costs(t: Tables, ties: str = "all") -> DataFrame:
    """Each product's costing rows on its latest calculation_date.

    ``ties='all'`` keeps every row of that date (parity); ``'one'`` keeps one.
    Rows without a date are never the latest.
    ``rank() == 1`` is planned with a map-side WindowGroupLimit, so a product
    with a long history is cut down before the shuffle.
    """
    order = [F.col("calculation_date").desc_nulls_last()]
    if ties == "one":
        order += [F.col("total").desc(), F.col("material_cost").desc()]
        fn = F.row_number()
    else:
        fn = F.rank()
    w = Window.partitionBy("product_id").orderBy(*order)
    return (t.costings.select("product_id", "total", "material_cost", "calculation_date")
            .filter(F.col("calculation_date").isNotNull())
            .withColumn("_rk", fn.over(w)).filter(F.col("_rk") == 1)
            .select("product_id", F.col("total").alias("product_cost"), "calculation_date"))


def profit_by_client(t: Tables, start=None, end=None, ties: str = "all") -> DataFrame:
    """Per client, COMPLETED orders with lines: order count, revenue, cost, profit.

    Lines are valued at the latest costing (0 when none; tied latest rows
    repeat a line, as in the reference). Lines meet the selected orders first
    and are summed per (client, product), so the costs join one row per pair,
    never the lines of a much-sold product; tied costs multiply the sums.
    """
    so = apply_filters(_completed(t), bound("order_date", start, end)).select(
        F.col("id").alias("order_id"), "client_id")
    costs = latest_costs(t, ties).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_ties"), F.sum(F.coalesce(F.col("product_cost"), F.lit(0))).alias("_unit"))
    sold = (t.order_products.select("order_id", "product_id", "quantity", "price").join(so, "order_id")
            .groupBy("client_id", "product_id")
            .agg(F.sum(F.col("quantity") * F.col("price")).alias("_rev"), F.sum("quantity").alias("_qty")))
    valued = sold.join(costs, "product_id", "left").groupBy("client_id").agg(
        F.sum(F.col("_rev") * F.coalesce(F.col("_ties"), F.lit(1))).alias("_rev"),
        F.sum(F.col("_qty").cast(WIDE_MONEY) * F.coalesce(F.col("_unit").cast(WIDE_MONEY), F.lit(0))).alias("_cost"))
    counts = (so.join(t.order_products.select("order_id"), "order_id", "left_semi")
              .groupBy("client_id").agg(F.count(F.lit(1)).alias("total_orders")))
    per_client = valued.join(counts, "client_id")
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (per_client.join(clients, "client_id")
            .select("client_id", "client_name", "total_orders",
                    wide("_rev").alias("total_revenue"), wide("_cost").alias("total_cost"),
                    wide(F.col("_rev") - F.col("_cost")).alias("total_profit"))
            .orderBy(desc("total_profit"), asc("client_id")))


# --- A9 -----------------------------------------------------------------------------
def payroll_report(t: Tables, start, end, employee_id=None) -> DataFrame:
    """Pay per active employee over an inclusive attendance range (both dates required).

    hourly_rate = salary / 160; overtime pays double; each absence deducts
    8 hours. Employees without attendance get zeros; a NULL salary gives NULL pay.
    """
    if not start or not end:
        raise ValueError("payroll_report needs both start and end dates")
    emp = apply_filters(t.employees.filter(active()), equals("id", employee_id))
    period = (t.attendances.filter(F.col("date").between(F.lit(D.as_date(start)), F.lit(D.as_date(end))))
              .groupBy("employee_id")
              .agg(F.sum(F.coalesce(F.col("overtime_hours"), F.lit(0))).alias("_ot"),
                   F.count_if(F.col("absence_reason").isNotNull()).alias("_abs")))
    joined = emp.join(period, emp["id"] == period["employee_id"], "left")
    rate = (F.col("salary") * F.lit(PER_HOUR)).cast(T.DecimalType(17, 7))  # exact: 1 / 160 has five places
    ot = F.coalesce(F.col("_ot"), F.lit(0)).cast(MONEY)
    absn = F.coalesce(F.col("_abs"), F.lit(0)).cast(T.LongType())
    ot_pay = (ot * F.lit(OVERTIME_FACTOR)).cast(T.DecimalType(14, 2)) * rate
    deduction = (absn * F.lit(ABSENCE_HOURS)).cast(T.DecimalType(12, 0)) * rate
    return (joined.select(
        F.col("id").alias("employee_id"), F.col("name").alias("employee_name"), "position",
        F.col("salary").alias("base_salary"), rate.alias("hourly_rate"),
        wide(ot).alias("total_overtime_hours"), ot_pay.alias("overtime_pay"),
        absn.alias("total_absence_days"), deduction.alias("absence_deduction"),
        (F.col("salary") + ot_pay - deduction).alias("total_pay"))
        .orderBy(asc("employee_name"), asc("employee_id")))


# --- A10 ----------------------------------------------------------------------------
def client_outstanding_balance(t: Tables, count_order_once: bool = False,
                               clients: DataFrame | None = None) -> DataFrame:
    """A10: per client, order totals over open (PENDING/OVERDUE) invoices; none -> 0.

    Parity: an order with two open invoices counts twice. Invoices are
    counted per order before the join, so the join reads one row per order.
    ``clients`` (a frame with ``client_id``) restricts the work to those
    clients: their orders are picked by a semi-join before the invoice join.
    """
    open_inv = (t.invoices.filter(F.col("status").isin(*OPEN_INVOICE))
                .groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")))
    weight = F.lit(1) if count_order_once else F.col("_n")
    orders = t.sales_orders.select("id", "client_id", "total")
    base = t.clients.select(F.col("id").alias("client_id"), "credit_limit")
    if clients is not None:
        wanted = clients.select("client_id").filter(F.col("client_id").isNotNull()).distinct()
        orders = orders.join(wanted, "client_id", "left_semi")
        base = base.join(wanted, "client_id", "left_semi")
    per_client = (orders.join(open_inv, orders["id"] == open_inv["order_id"])
                  .groupBy("client_id").agg(F.sum(F.col("total") * weight).alias("_bal")))
    return (base
            .join(per_client, "client_id", "left")
            .select("client_id", "credit_limit",
                    wide(F.coalesce(F.col("_bal"), F.lit(0))).alias("outstanding_balance")))


# --- A11-A16 (dashboard and notifications) -------------------------------------------
def _low_stock(t: Tables) -> DataFrame:
    return t.products.filter(active() & (F.col("current_stock") <= F.col("min_stock")))


def dashboard_kpis(t: Tables, as_of) -> DataFrame:
    """Six dashboard scalars in one row; NULL sums become 0; upper bounds stay open.

    One conditional aggregate per table; the others join the first as scalar
    subqueries (no cartesian product).
    """
    today = D.as_date(as_of)
    ms = D.month_start(today)
    this_month = t.sales_orders.filter(F.col("order_date") >= F.lit(ms))
    is_new = F.col("order_date") == F.lit(today)
    new = F.coalesce(F.sum(F.when(is_new, F.col("orders"))), F.lit(0)) if "orders" in this_month.columns else F.count_if(is_new)
    sales = this_month.agg(
        wide(F.coalesce(F.sum(F.when(F.col("status") == COMPLETED, F.col("total"))), F.lit(0))).alias("total_sales_month"),
        new.alias("new_orders_today"))
    in_progress = t.production_orders.filter(F.col("status") == "IN_PROGRESS").select(F.count("id")).scalar()
    low = _low_stock(t).select(F.count("id")).scalar()
    incomes = t.incomes.filter(F.col("date") >= F.lit(ms)).select(
        wide(F.coalesce(F.sum("amount"), F.lit(0)))).scalar()
    expenses = t.expenses.filter(F.col("date") >= F.lit(ms)).select(
        wide(F.coalesce(F.sum("amount"), F.lit(0)))).scalar()
    return sales.select("total_sales_month", "new_orders_today",
                        in_progress.alias("orders_in_progress"), low.alias("low_stock_items"),
                        incomes.alias("total_incomes_month"), expenses.alias("total_expenses_month"))


def critical_stock_top(t: Tables, k: int = 5) -> DataFrame:
    """The k active low-stock products furthest below their minimum."""
    return (_low_stock(t).select("id", "sku", "description", "current_stock", "min_stock")
            .orderBy(asc(F.col("current_stock") - F.col("min_stock")), asc("id")).limit(k))


def pending_quotes_top(t: Tables, k: int = 5) -> DataFrame:
    """Newest k QUOTE orders with the client name."""
    so = t.sales_orders.filter(F.col("status") == "QUOTE")
    c = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return (so.join(c, "client_id").select("id", "order_number", "client_name", "total", "order_date")
            .orderBy(desc("order_date"), desc("id")).limit(k).drop("order_date"))


def active_production_top(t: Tables, k: int = 5) -> DataFrame:
    """K IN_PROGRESS production orders with the earliest planned start."""
    po = t.production_orders.filter(F.col("status") == "IN_PROGRESS")
    p = t.products.select(F.col("id").alias("product_id"), F.col("description").alias("product_description"))
    return (po.join(p, "product_id")
            .select("id", "order_number", "product_description", "quantity", "planned_start_date")
            .orderBy(asc("planned_start_date"), asc("id")).limit(k).drop("planned_start_date"))


def top_clients_month(t: Tables, as_of, k: int = 5) -> DataFrame:
    """Top clients by name on COMPLETED sales since the first of the month."""
    so = _completed(t).filter(F.col("order_date") >= F.lit(D.month_start(as_of)))
    return _top_client_names(so, t, k)


def notification_counts(t: Tables) -> DataFrame:
    """Low-stock products, QUOTE orders, PENDING production orders (one row)."""
    low = _low_stock(t).agg(F.count("id").alias("low_stock_count"))
    quotes = t.sales_orders.filter(F.col("status") == "QUOTE").select(F.count("id")).scalar()
    pending = t.production_orders.filter(F.col("status") == "PENDING").select(F.count("id")).scalar()
    return low.select("low_stock_count", quotes.alias("pending_quotes_count"),
                      pending.alias("pending_production_count"))


def dashboard_lists(t: Tables, as_of, k: int = 5) -> dict[str, DataFrame]:
    """The four dashboard lists of A12-A15 by name."""
    return {
        "lowStockList": critical_stock_top(t, k),
        "pendingQuotes": pending_quotes_top(t, k),
        "inProgressOrders": active_production_top(t, k),
        "topClients": top_clients_month(t, as_of, k),
    }
