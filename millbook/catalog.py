"""Registered queries: each operator bound to the fixture parameters.

Every entry is ``fn(spark, sf_dir) -> DataFrame``: it derives the ERP tables
from the driver tables under ``sf_dir`` (whole tables) and runs one library
operator on them. Output goes through :func:`portable` so the SQL oracle
can compare values across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millbook.operators import reports as R
from millbook.plans.portable import portable
from millbook.session import ship_package
from millbook.sources.fixtures import AS_OF, PAYROLL_END, PAYROLL_START, derive_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

AS_OF_DEFAULT = AS_OF

# Fixed parameters of the registered variants.
RANGE_START, RANGE_END = "1997-01-01", "1998-12-31"
FULL_START, FULL_END = "1990-01-01", "2030-12-31"
WASTE_START, WASTE_END = "1996-01-01", "1999-01-01"

_REGISTRY: dict[str, QueryFn] = {}


def register(name: str, nullable_ints: tuple[str, ...] = ()):
    def deco(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return portable(fn(derive_tables(spark, sf_dir)), nullable_ints)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def register_session(name: str, nullable_ints: tuple[str, ...] = ()):
    """Register a query that needs the session itself (streams), output made portable."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return portable(fn(spark, sf_dir), nullable_ints)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    # import for registration side effects
    from millbook import catalog_listings, catalog_changes  # noqa: F401
    return dict(_REGISTRY)


# ---- reports ------------------------------------------------------------------------
@register("sales_by_client")
def _a1(t):
    """A1 over all COMPLETED orders."""
    return R.sales_by_client(t)


@register("sales_by_client_range")
def _a1r(t):
    """A1 with an inclusive order_date range."""
    return R.sales_by_client(t, RANGE_START, RANGE_END)


@register("sales_over_time")
def _a2(t):
    """A2 default period: days of the last 7 days before as_of."""
    return R.sales_over_time(t, AS_OF)


@register("sales_over_time_today")
def _a2_today(t):
    return R.sales_over_time(t, AS_OF, period="today")


@register("sales_over_time_weekly")
def _a2_week(t):
    return R.sales_over_time(t, AS_OF, period="weekly")


@register("sales_over_time_monthly")
def _a2_month(t):
    return R.sales_over_time(t, AS_OF, period="monthly")


@register("sales_over_time_yearly")
def _a2_year(t):
    return R.sales_over_time(t, AS_OF, period="yearly")


@register("sales_over_time_range")
def _a2_range(t):
    """A2 with both dates: day buckets over the whole order history."""
    return R.sales_over_time(t, AS_OF, start=FULL_START, end=FULL_END)


@register("sales_kpis")
def _a3(t):
    """A3 over the whole order history (both dates given)."""
    return R.sales_kpis(t, AS_OF, start=FULL_START, end=FULL_END)


@register("sales_kpis_monthly")
def _a3m(t):
    return R.sales_kpis(t, AS_OF, period="monthly")


@register("top_clients")
def _a4(t):
    return R.top_clients(t, AS_OF, start=FULL_START, end=FULL_END)


@register("waste_by_process")
def _a5(t):
    return R.waste_by_process(t)


@register("waste_by_process_range")
def _a5r(t):
    return R.waste_by_process(t, WASTE_START, WASTE_END)


@register("production_cost_texts")
def _a6t(t):
    """A6 in the endpoint's own spelling: doubles as toFixed(2) texts."""
    return R.production_cost_texts(t)


@register("production_cost_analysis")
def _a6(t):
    return R.production_cost_analysis(t)


@register("profit_by_client")
def _a7(t):
    return R.profit_by_client(t)


@register("profit_by_client_range")
def _a7r(t):
    return R.profit_by_client(t, RANGE_START, RANGE_END)


@register("latest_costs")
def _a8(t):
    return R.latest_costs(t)


@register("payroll_report")
def _a9(t):
    return R.payroll_report(t, PAYROLL_START, PAYROLL_END)


@register("client_outstanding_balance")
def _a10(t):
    return R.client_outstanding_balance(t)


@register("dashboard_kpis")
def _a11(t):
    return R.dashboard_kpis(t, AS_OF)


@register("critical_stock_top5")
def _a12(t):
    return R.critical_stock_top(t)


@register("pending_quotes_top5")
def _a13(t):
    return R.pending_quotes_top(t)


@register("active_production_top5")
def _a14(t):
    return R.active_production_top(t)


@register("top_clients_month")
def _a15(t):
    return R.top_clients_month(t, AS_OF)


@register("notification_counts")
def _a16(t):
    return R.notification_counts(t)
