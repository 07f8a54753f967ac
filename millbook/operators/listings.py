"""Listings Q1-Q20: scan, optional filters, equi-join to a dimension, sort.

Every listing returns the whole filtered result sorted in a total order
(PostgreSQL null placement, ``id`` as the last key); pass ``page`` to get one
page plus totals instead (:func:`millbook.functions.paging.page_with_totals`).
Listings by a text column take a ``collation`` (see
:mod:`millbook.functions.ordering`); without one text sorts by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millbook.functions.filters import active, apply_filters, bound, equals, search
from millbook.functions.ordering import asc, desc
from millbook.functions.paging import page_with_totals
from millbook.operators.search import TrigramIndex, indexed_search
from millbook.sources.tables import Tables


def _finish(df: DataFrame, keys: list[Column], page=None, limit=None, default_limit: int = 10) -> DataFrame:
    if page is None and limit is None:
        return df.orderBy(*keys)
    return page_with_totals(df, keys, page, limit, default_limit)


def _name(df: DataFrame, key: str, alias: str, id_col: str = "id", name_col: str = "name") -> DataFrame:
    return df.select(F.col(id_col).alias(key), F.col(name_col).alias(alias))


def _searched(df: DataFrame, columns: list[str], text, indexes: list | None) -> DataFrame:
    """``df`` filtered by the search, through trigram postings where there are any."""
    cond = search(columns, text)
    if cond is None:
        return df
    return indexed_search(df, columns, text, indexes) if indexes else df.filter(cond)


# Q1
def list_clients(t: Tables, search_text=None, page=None, limit=None, index: TrigramIndex | None = None,
                 collation: str | None = None) -> DataFrame:
    """Active clients, optional search on code or name (``index``: postings of both), by name."""
    df = _searched(t.clients.filter(active()), ["code", "name"], search_text, index and [("id", index)])
    return _finish(df, [asc("name", collation), asc("id")], page, limit)


# Q2
def list_sales_orders(t: Tables, search_text=None, page=None, limit=None,
                      indexes: tuple[TrigramIndex, TrigramIndex] | None = None) -> DataFrame:
    """Order headers with client name; search order_number or client name; newest first.

    ``indexes``: postings of the orders' numbers and of the clients' names.
    """
    df = t.sales_orders.join(_name(t.clients, "client_id", "client_name"), "client_id")
    keyed = indexes and list(zip(("id", "client_id"), indexes, strict=True))
    df = _searched(df, ["order_number", "client_name"], search_text, keyed).select(
        "id", "order_number", "order_date", "delivery_date", "status", "total", "client_name")
    return _finish(df, [desc("order_date"), desc("id")], page, limit)


# Q3
LINE_FIELDS = ("quantity", "price", "sku", "description", "unit")


def sales_order_details(t: Tables, order_ids: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """Order header + client name/code/address + its product lines.

    Default: one row per (order, line) with the line's quantity, price, sku,
    description and unit; an order without lines appears once with NULL line
    columns; an id without an order gives no row. No group is gathered, so an
    order with a huge number of lines is no burden.

    ``nested=True`` returns one row per order with the lines as a sorted
    ``products`` array (empty when none), the reference's response shape;
    it gathers each order's lines into one row, so use it for id sets whose
    orders have a bounded number of lines. ``order_ids`` (first column)
    restricts the orders through a semi-join.
    """
    so = t.sales_orders
    if order_ids is not None:
        so = so.join(order_ids.select(F.col(order_ids.columns[0]).alias("id")), "id", "left_semi")
    prod = t.products.select(F.col("id").alias("product_id"), "sku", "description", "unit")
    ol = t.order_products
    if order_ids is not None:
        ol = ol.join(so.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    lines = ol.join(prod, "product_id").select("order_id", *LINE_FIELDS)
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"),
                               F.col("code").alias("client_code"), F.col("address").alias("client_address"))
    head = so.join(clients, "client_id").select(
        "id", "order_number", "order_date", "delivery_date", "status", "subtotal", "tax_amount", "total",
        "notes", "client_name", "client_code", "client_address")
    if not nested:
        return (head.join(lines, head["id"] == lines["order_id"], "left")
                .select(*[head[c] for c in head.columns], *[lines[c] for c in LINE_FIELDS]))
    grouped = lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*LINE_FIELDS))).alias("products"))
    empty = F.array().cast(grouped.schema["products"].dataType)
    return (head.join(grouped, head["id"] == grouped["order_id"], "left")
            .select(*[head[c] for c in head.columns], F.coalesce(F.col("products"), empty).alias("products")))


# Q4
def list_products(t: Tables, search_text=None, page=None, limit=None, index: TrigramIndex | None = None,
                  collation: str | None = None) -> DataFrame:
    """Active products with supplier name (kept when none); search sku/description (``index``: postings of both); by sku."""
    df = _searched(t.products.filter(active()), ["sku", "description"], search_text, index and [("id", index)])
    df = df.join(_name(t.suppliers, "supplier_id", "supplier_name"), "supplier_id", "left")
    return _finish(df, [asc("sku", collation), asc("id")], page, limit)


# Q5
def low_stock_products(t: Tables, collation: str | None = None) -> DataFrame:
    """Active products at or below their minimum stock, by sku."""
    df = t.products.filter(active() & (F.col("current_stock") <= F.col("min_stock")))
    return df.orderBy(asc("sku", collation), asc("id"))


# Q6
def list_production_orders(t: Tables, status=None, search_text=None, product_id=None,
                           page=None, limit=None) -> DataFrame:
    """Production orders with product sku/description; filters; latest planned start first."""
    prod = t.products.select(F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
                             F.col("description").alias("product_description"))
    po = apply_filters(t.production_orders, equals("status", status), equals("product_id", product_id))
    df = apply_filters(po.join(prod, "product_id"), search(["order_number", "product_description"], search_text))
    df = df.select("id", "order_number", "quantity", "status", "priority", "planned_start_date",
                   "planned_end_date", "product_sku", "product_description")
    return _finish(df, [desc("planned_start_date"), desc("id")], page, limit)


# Q7
def production_order_details(t: Tables, order_ids: DataFrame | None = None) -> DataFrame:
    """``po.*`` plus product sku/description for a set of ids (all orders when None)."""
    po = t.production_orders
    if order_ids is not None:
        po = po.join(order_ids.select(F.col(order_ids.columns[0]).alias("id")), "id", "left_semi")
    prod = t.products.select(F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
                             F.col("description").alias("product_description"))
    return po.join(prod, "product_id").select(*po.columns, "product_sku", "product_description")


# Q8
def waste_report(t: Tables, order_id=None, start=None, end=None) -> DataFrame:
    """Waste rows with the production order number; newest first.

    Date bounds are midnights on the timestamp column.
    """
    w = apply_filters(t.wastes, equals("order_id", order_id), bound("date", start, end))
    po = t.production_orders.select(F.col("id").alias("order_id"), "order_number")
    df = w.join(po, "order_id").select("id", "date", "process", "quantity", "reason", "order_number")
    return df.orderBy(desc("date"), desc("id"), asc("process"), asc("quantity"), asc("order_number"))


# Q9
def list_incomes(t: Tables, source=None, start=None, end=None, page=None, limit=None) -> DataFrame:
    df = apply_filters(t.incomes, search(["source"], source), bound("date", start, end))
    return _finish(df, [desc("date"), desc("id")], page, limit)


# Q10
def list_expenses(t: Tables, category=None, supplier_id=None, start=None, end=None,
                  page=None, limit=None) -> DataFrame:
    """Expenses with supplier name (kept when none); newest first."""
    e = apply_filters(t.expenses, search(["category"], category), equals("supplier_id", supplier_id),
                      bound("date", start, end))
    df = e.join(_name(t.suppliers, "supplier_id", "supplier_name"), "supplier_id", "left")
    return _finish(df, [desc("date"), desc("id"), asc("amount"), asc("category")], page, limit)


# Q11
def costing_history(t: Tables, product_id=None) -> DataFrame:
    """All costings of a product (or of all products), newest first."""
    df = apply_filters(t.costings, equals("product_id", product_id))
    return df.orderBy(asc("product_id"), desc("calculation_date"), desc("total"), desc("material_cost"))


# Q12
def list_employees(t: Tables, search_text=None, page=None, limit=None, collation: str | None = None) -> DataFrame:
    df = apply_filters(t.employees.filter(active()), search(["name", "position"], search_text)).select(
        "id", "name", "position", "shift", "hire_date", "salary", "is_active")
    return _finish(df, [asc("name", collation), asc("id")], page, limit)


# Q13
def list_users(t: Tables, page=None, limit=None, collation: str | None = None) -> DataFrame:
    """All users (inactive too) with the employee name and last login; no password column."""
    df = t.users.join(_name(t.employees, "employee_id", "employee_name"), "employee_id", "left").select(
        "id", "username", "email", "role", "is_active", "last_login", "employee_name")
    return _finish(df, [asc("username", collation), asc("id")], page, limit)


# Q14
def attendance_roster(t: Tables, employee_id=None, start=None, end=None, collation: str | None = None) -> DataFrame:
    """Every active employee with their attendance rows in range.

    The filters belong to the join condition, so attendances are filtered
    first and employees without a matching row appear once with NULLs.
    """
    a = apply_filters(t.attendances, equals("employee_id", employee_id), bound("date", start, end))
    a = a.select(F.col("employee_id").alias("_eid"), "id", "date", "entry_time", "exit_time",
                 "absence_reason", "overtime_hours")
    e = t.employees.filter(active()).select(F.col("id").alias("employee_id"),
                                              F.col("name").alias("employee_name"), "position")
    df = e.join(a, e["employee_id"] == a["_eid"], "left").drop("_eid")
    return df.orderBy(asc("employee_name", collation), asc("employee_id"), asc("date"), asc("id"))


# Q15
def list_shifts(t: Tables, employee_id=None, start=None, end=None, collation: str | None = None) -> DataFrame:
    """Shifts with the employee name (inactive employees too); newest first, then name."""
    s = apply_filters(t.shifts, equals("employee_id", employee_id), bound("date", start, end))
    df = s.join(_name(t.employees, "employee_id", "employee_name"), "employee_id").select(
        *t.shifts.columns, "employee_name")
    return df.orderBy(desc("date"), asc("employee_name", collation), asc("id"))


# Q16
def list_audits(t: Tables, user_id=None, action=None, start=None, end=None, page=None, limit=None) -> DataFrame:
    """Audit rows with the username; newest first; pages of 15 by default."""
    a = apply_filters(t.audits, equals("user_id", user_id), search(["action"], action),
                      bound("timestamp", start, end))
    df = a.join(_name(t.users, "user_id", "user_name", name_col="username"), "user_id").select(
        "id", "timestamp", "action", "details", "user_name")
    return _finish(df, [desc("timestamp"), desc("id")], page, limit, default_limit=15)


# Q17
def list_suppliers(t: Tables, collation: str | None = None) -> DataFrame:
    return t.suppliers.filter(active()).select("id", "name").orderBy(asc("name", collation), asc("id"))


# Q18
LOOKUP_ACTIVE_ONLY = {"clients": True, "products": True, "employees": True, "users": False, "shifts": False}


def lookup_active(t: Tables, table: str, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is in ``ids`` (first column); clients, products and
    employees only while active, users and shifts in any state. A semi-join, so
    repeated ids give one row."""
    df = t[table]
    if LOOKUP_ACTIVE_ONLY[table]:
        df = df.filter(active())
    return df.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")


# Q19
def user_effective_role(t: Tables, username=None) -> DataFrame:
    """Active users whose ``role`` is their employee's position (NULL without one)."""
    u = apply_filters(t.users.filter(active()), equals("username", username)).drop("role")
    e = t.employees.select(F.col("id").alias("employee_id"), F.col("position").alias("role"))
    return u.join(e, "employee_id", "left").select(*[c for c in t.users.columns if c != "role"], "role")
