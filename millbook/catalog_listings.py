"""Registered listing queries Q1-Q20 (whole tables; paging only in the page variants)."""

from __future__ import annotations

import uuid

from millbook.catalog import register
from millbook.operators import listings as L
from millbook.operators.search import TrigramIndex
from millbook.plans.lineage import shared_dir
from millbook.sources.fixtures import PAYROLL_END, PAYROLL_START


@register("list_clients")
def _q1(t):
    return L.list_clients(t)


@register("list_clients_search")
def _q1s(t):
    """Q1 with a search that matches codes and names (ILIKE, case-insensitive)."""
    return L.list_clients(t, search_text="r#00000001")


@register("list_sales_orders")
def _q2(t):
    return L.list_sales_orders(t)


@register("list_sales_orders_search")
def _q2s(t):
    return L.list_sales_orders(t, search_text="so-1998")


@register("sales_order_details")
def _q3(t):
    """Q3 for every order: header and client with one row per product line."""
    return L.sales_order_details(t)


@register("list_products", nullable_ints=("supplier_id",))
def _q4(t):
    return L.list_products(t)


@register("list_products_search", nullable_ints=("supplier_id",))
def _q4s(t):
    return L.list_products(t, search_text="GEAR")


@register("low_stock_products", nullable_ints=("supplier_id",))
def _q5(t):
    return L.low_stock_products(t)


@register("list_production_orders")
def _q6(t):
    return L.list_production_orders(t)


@register("list_production_orders_filtered")
def _q6f(t):
    return L.list_production_orders(t, status="IN_PROGRESS", search_text="widget")


@register("production_order_details")
def _q7(t):
    return L.production_order_details(t)


@register("waste_report")
def _q8(t):
    return L.waste_report(t)


@register("waste_report_range")
def _q8r(t):
    return L.waste_report(t, start="1997-03-01", end="1997-06-30")


@register("list_incomes", nullable_ints=("invoice_id",))
def _q9(t):
    return L.list_incomes(t)


@register("list_incomes_filtered", nullable_ints=("invoice_id",))
def _q9f(t):
    return L.list_incomes(t, source="urgent", start="1996-01-01", end="1997-12-31")


@register("list_expenses", nullable_ints=("supplier_id",))
def _q10(t):
    return L.list_expenses(t)


@register("list_expenses_filtered", nullable_ints=("supplier_id",))
def _q10f(t):
    return L.list_expenses(t, category="mat", start="1999-01-01", end="2000-12-31")


@register("costing_history")
def _q11(t):
    return L.costing_history(t)


@register("list_employees")
def _q12(t):
    return L.list_employees(t)


@register("list_employees_search")
def _q12s(t):
    return L.list_employees(t, search_text="position 3")


@register("list_users")
def _q13(t):
    return L.list_users(t)


@register("attendance_roster", nullable_ints=("id",))
def _q14(t):
    return L.attendance_roster(t, start=PAYROLL_START, end=PAYROLL_END)


@register("list_shifts")
def _q15(t):
    return L.list_shifts(t)


@register("list_shifts_range")
def _q15r(t):
    return L.list_shifts(t, start="2024-01-10", end="2024-01-12")


@register("list_audits")
def _q16(t):
    return L.list_audits(t)


@register("list_audits_filtered")
def _q16f(t):
    return L.list_audits(t, action="CLI", start="2024-01-03", end="2024-01-20")


@register("list_suppliers")
def _q17(t):
    return L.list_suppliers(t)


@register("lookup_active_clients")
def _q18c(t):
    """Q18: active clients referenced by any order."""
    return L.lookup_active(t, "clients", t.sales_orders.select("client_id"))


@register("lookup_active_products", nullable_ints=("supplier_id",))
def _q18p(t):
    """Q18: active products that appear on order lines."""
    return L.lookup_active(t, "products", t.order_products.select("product_id"))


@register("lookup_active_employees")
def _q18e(t):
    return L.lookup_active(t, "employees", t.attendances.select("employee_id"))


@register("lookup_users", nullable_ints=("employee_id",))
def _q18u(t):
    """Q18: users named by the audit log, in any state."""
    return L.lookup_active(t, "users", t.audits.select("user_id"))


@register("user_effective_role", nullable_ints=("employee_id",))
def _q19(t):
    return L.user_effective_role(t)


@register("list_sales_orders_page")
def _q20a(t):
    """Q20: page 3 of 10 of the order listing with totals."""
    return L.list_sales_orders(t, page=3, limit=10)


@register("list_audits_page")
def _q20b(t):
    """Q20: page 2 of the audit listing at the default 15 rows, filtered by action."""
    return L.list_audits(t, action="view", page=2)


@register("list_products_page", nullable_ints=("supplier_id",))
def _q20c(t):
    return L.list_products(t, search_text="bolt", page=4, limit=25)


@register("list_clients_page")
def _q20d(t):
    """Q20: a page beyond the last one gives no rows."""
    return L.list_clients(t, page=10 ** 6, limit=10)



# ---- searches through trigram postings -----------------------------------------------------
def _index(t, table, *columns):
    """Postings of a whole table, written now."""
    rows = t[table]
    index = TrigramIndex(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/trigrams/{table}-{uuid.uuid4().hex}", columns)
    index.add(rows)
    return index


@register("list_clients_indexed_search")
def _q1i(t):
    """Q1's search through postings of codes and names."""
    return L.list_clients(t, search_text="r#00000001", index=_index(t, "clients", "code", "name"))


@register("list_sales_orders_indexed_search")
def _q2i(t):
    """Q2's search through postings of order numbers and of client names."""
    return L.list_sales_orders(t, search_text="000077", indexes=(_index(t, "sales_orders", "order_number"),
                                                                 _index(t, "clients", "name")))


@register("list_products_indexed_search", nullable_ints=("supplier_id",))
def _q4i(t):
    """Q4's search through postings, with live wildcards between two literal runs."""
    return L.list_products(t, search_text="hot g%r", index=_index(t, "products", "sku", "description"))


# ---- deep pages -------------------------------------------------------------------------
@register("list_sales_orders_deep_page")
def _q20d(t):
    """Q20: page 120 of 10: only the range parts it lies in are sorted."""
    return L.list_sales_orders(t, page=120, limit=10)


@register("list_audits_deep_page")
def _q20da(t):
    """Q20: a deep page of the audits that runs over its range part's end."""
    return L.list_audits(t, page=3, limit=900)


@register("list_products_collated_page", nullable_ints=("supplier_id",))
def _q4c(t):
    """Q4 by Spanish collation: page 3 of 40."""
    return L.list_products(t, page=3, limit=40, collation="es")
