"""Oracle SQL for the listings Q1-Q20."""

from __future__ import annotations

from millbook.oracle import BODIES

CLIENT = ("c.id, c.code, c.name, c.address, CAST(c.credit_limit AS DOUBLE) AS credit_limit, "
          "c.payment_terms, c.is_active")
PRODUCT = ("p.id, p.sku, p.description, p.type, p.unit, CAST(p.cost_price AS DOUBLE) AS cost_price, "
           "CAST(p.min_stock AS DOUBLE) AS min_stock, CAST(p.current_stock AS DOUBLE) AS current_stock, "
           "CAST(p.supplier_id AS DOUBLE) AS supplier_id, p.is_active")
EMPLOYEE = ("e.id, e.name, e.position, e.shift, CAST(e.hire_date AS TIMESTAMP) AS hire_date, "
            "CAST(e.salary AS DOUBLE) AS salary, e.is_active")
ORDER_ROW = ("so.id, so.order_number, CAST(so.order_date AS TIMESTAMP) AS order_date, "
             "CAST(so.delivery_date AS TIMESTAMP) AS delivery_date, so.status, CAST(so.total AS DOUBLE) AS total, "
             "c.name AS client_name")
PO_ROW = ("po.id, po.order_number, CAST(po.quantity AS DOUBLE) AS quantity, po.status, po.priority, "
          "CAST(po.planned_start_date AS TIMESTAMP) AS planned_start_date, "
          "CAST(po.planned_end_date AS TIMESTAMP) AS planned_end_date, p.sku AS product_sku, "
          "p.description AS product_description")
INCOME = ("i.id, CAST(i.amount AS DOUBLE) AS amount, CAST(i.date AS TIMESTAMP) AS date, i.source, CAST(i.invoice_id AS DOUBLE) AS invoice_id")
EXPENSE = ("e.id, CAST(e.amount AS DOUBLE) AS amount, CAST(e.date AS TIMESTAMP) AS date, e.category, "
           "CAST(e.supplier_id AS DOUBLE) AS supplier_id, s.name AS supplier_name")
WASTE = ("w.id, w.date, w.process, CAST(w.quantity AS DOUBLE) AS quantity, w.reason, po.order_number")
AUDIT = "a.id, a.timestamp, a.action, a.details, u.username AS user_name"
SHIFT = ("s.id, s.employee_id, CAST(s.date AS TIMESTAMP) AS date, s.machine, "
         "CAST(s.duration AS DOUBLE) AS duration, e.name AS employee_name")


def _page(base: str, order: str, page: int, limit: int) -> str:
    return f"""
WITH base AS ({base}), cnt AS (SELECT count(*) AS n FROM base)
SELECT b.*, cnt.n AS total_items, CAST(ceil(cnt.n / {float(limit)}) AS BIGINT) AS total_pages,
       CAST({page} AS INTEGER) AS current_page
FROM (SELECT * FROM base ORDER BY {order} LIMIT {limit} OFFSET {(page - 1) * limit}) b CROSS JOIN cnt"""


ORDERS_BASE = f"SELECT {ORDER_ROW} FROM sales_orders so JOIN clients c ON so.client_id = c.id"
PRODUCTS_BASE = f"SELECT {PRODUCT}, s.name AS supplier_name FROM products p LEFT JOIN suppliers s ON p.supplier_id = s.id WHERE p.is_active = TRUE"
AUDITS_BASE = f"SELECT {AUDIT} FROM audits a JOIN users u ON a.user_id = u.id"

BODIES.update({
    "list_clients": f"SELECT {CLIENT} FROM clients c WHERE c.is_active = TRUE",
    "list_clients_search": f"""
SELECT {CLIENT} FROM clients c WHERE c.is_active = TRUE
AND (c.code ILIKE '%r#00000001%' OR c.name ILIKE '%r#00000001%')""",
    "list_sales_orders": ORDERS_BASE,
    "list_sales_orders_search": f"{ORDERS_BASE} WHERE so.order_number ILIKE '%so-1998%' OR c.name ILIKE '%so-1998%'",
    "sales_order_details": """
WITH lines AS (SELECT op.order_id, CAST(op.quantity AS DOUBLE) AS quantity, CAST(op.price AS DOUBLE) AS price,
                      p.sku, p.description, p.unit
               FROM order_products op JOIN products p ON op.product_id = p.id)
SELECT so.id, so.order_number, CAST(so.order_date AS TIMESTAMP) AS order_date,
       CAST(so.delivery_date AS TIMESTAMP) AS delivery_date, so.status, CAST(so.subtotal AS DOUBLE) AS subtotal,
       CAST(so.tax_amount AS DOUBLE) AS tax_amount, CAST(so.total AS DOUBLE) AS total, so.notes,
       c.name AS client_name, c.code AS client_code, c.address AS client_address,
       lines.quantity, lines.price, lines.sku, lines.description, lines.unit
FROM sales_orders so JOIN clients c ON so.client_id = c.id LEFT JOIN lines ON lines.order_id = so.id""",
    "list_products": PRODUCTS_BASE,
    "list_products_search": f"{PRODUCTS_BASE} AND (p.sku ILIKE '%GEAR%' OR p.description ILIKE '%GEAR%')",
    "low_stock_products": f"SELECT {PRODUCT} FROM products p WHERE p.current_stock <= p.min_stock AND p.is_active = TRUE",
    "list_production_orders": f"SELECT {PO_ROW} FROM production_orders po JOIN products p ON po.product_id = p.id",
    "list_production_orders_filtered": f"""
SELECT {PO_ROW} FROM production_orders po JOIN products p ON po.product_id = p.id
WHERE po.status = 'IN_PROGRESS' AND (po.order_number ILIKE '%widget%' OR p.description ILIKE '%widget%')""",
    "production_order_details": """
SELECT po.id, po.order_number, po.product_id, CAST(po.quantity AS DOUBLE) AS quantity, po.status, po.priority,
       CAST(po.planned_start_date AS TIMESTAMP) AS planned_start_date,
       CAST(po.planned_end_date AS TIMESTAMP) AS planned_end_date,
       p.sku AS product_sku, p.description AS product_description
FROM production_orders po JOIN products p ON po.product_id = p.id""",
    "waste_report": f"SELECT {WASTE} FROM wastes w JOIN production_orders po ON w.order_id = po.id",
    "waste_report_range": f"""
SELECT {WASTE} FROM wastes w JOIN production_orders po ON w.order_id = po.id
WHERE w.date >= DATE '1997-03-01' AND w.date <= DATE '1997-06-30'""",
    "list_incomes": f"SELECT {INCOME} FROM incomes i",
    "list_incomes_filtered": f"""
SELECT {INCOME} FROM incomes i
WHERE i.source ILIKE '%urgent%' AND i.date >= DATE '1996-01-01' AND i.date <= DATE '1997-12-31'""",
    "list_expenses": f"SELECT {EXPENSE} FROM expenses e LEFT JOIN suppliers s ON e.supplier_id = s.id",
    "list_expenses_filtered": f"""
SELECT {EXPENSE} FROM expenses e LEFT JOIN suppliers s ON e.supplier_id = s.id
WHERE e.category ILIKE '%mat%' AND e.date >= DATE '1999-01-01' AND e.date <= DATE '2000-12-31'""",
    "costing_history": """
SELECT product_id, CAST(material_cost AS DOUBLE) AS material_cost, CAST(labor_cost AS DOUBLE) AS labor_cost,
       CAST(waste_cost AS DOUBLE) AS waste_cost, CAST(total AS DOUBLE) AS total,
       CAST(calculation_date AS TIMESTAMP) AS calculation_date
FROM costings""",
    "list_employees": f"SELECT {EMPLOYEE} FROM employees e WHERE e.is_active = TRUE",
    "list_employees_search": f"""
SELECT {EMPLOYEE} FROM employees e WHERE e.is_active = TRUE
AND (e.name ILIKE '%position 3%' OR e.position ILIKE '%position 3%')""",
    "list_users": """
SELECT u.id, u.username, u.email, u.role, u.is_active, u.last_login, e.name AS employee_name
FROM users u LEFT JOIN employees e ON u.employee_id = e.id""",
    "attendance_roster": """
SELECT e.id AS employee_id, e.name AS employee_name, e.position, CAST(a.id AS DOUBLE) AS id, CAST(a.date AS TIMESTAMP) AS date,
       a.entry_time, a.exit_time, a.absence_reason, CAST(a.overtime_hours AS DOUBLE) AS overtime_hours
FROM employees e LEFT JOIN attendances a
  ON e.id = a.employee_id AND a.date >= DATE '2024-01-05' AND a.date <= DATE '2024-01-19'
WHERE e.is_active = TRUE""",
    "list_shifts": f"SELECT {SHIFT} FROM shifts s JOIN employees e ON s.employee_id = e.id",
    "list_shifts_range": f"""
SELECT {SHIFT} FROM shifts s JOIN employees e ON s.employee_id = e.id
WHERE s.date >= DATE '2024-01-10' AND s.date <= DATE '2024-01-12'""",
    "list_audits": AUDITS_BASE,
    "list_audits_filtered": f"""
{AUDITS_BASE} WHERE a.action ILIKE '%CLI%' AND a.timestamp >= DATE '2024-01-03' AND a.timestamp <= DATE '2024-01-20'""",
    "list_suppliers": "SELECT id, name FROM suppliers WHERE is_active = TRUE",
    "lookup_active_clients": f"""
SELECT {CLIENT} FROM clients c WHERE c.is_active = TRUE AND c.id IN (SELECT client_id FROM sales_orders)""",
    "lookup_active_products": f"""
SELECT {PRODUCT} FROM products p WHERE p.is_active = TRUE AND p.id IN (SELECT product_id FROM order_products)""",
    "lookup_active_employees": f"""
SELECT {EMPLOYEE} FROM employees e WHERE e.is_active = TRUE AND e.id IN (SELECT employee_id FROM attendances)""",
    "lookup_users": """
SELECT id, CAST(employee_id AS DOUBLE) AS employee_id, username, email, role, is_active, last_login FROM users WHERE id IN (SELECT user_id FROM audits)""",
    "user_effective_role": """
SELECT u.id, CAST(u.employee_id AS DOUBLE) AS employee_id, u.username, u.email, u.is_active, u.last_login, e.position AS role
FROM users u LEFT JOIN employees e ON u.employee_id = e.id WHERE u.is_active = TRUE""",
    "list_sales_orders_page": _page(ORDERS_BASE, "order_date DESC, id DESC", 3, 10),
    "list_audits_page": _page(f"{AUDITS_BASE} WHERE a.action ILIKE '%view%'", "timestamp DESC, id DESC", 2, 15),
    "list_products_page": _page(f"{PRODUCTS_BASE} AND (p.sku ILIKE '%bolt%' OR p.description ILIKE '%bolt%')",
                                "sku, id", 4, 25),
    "list_clients_indexed_search": f"""
SELECT {CLIENT} FROM clients c WHERE c.is_active = TRUE
AND (c.code ILIKE '%r#00000001%' OR c.name ILIKE '%r#00000001%')""",
    "list_sales_orders_indexed_search":
        f"{ORDERS_BASE} WHERE so.order_number ILIKE '%000077%' OR c.name ILIKE '%000077%'",
    "list_products_indexed_search":
        f"{PRODUCTS_BASE} AND (p.sku ILIKE '%hot g%r%' OR p.description ILIKE '%hot g%r%')",
    "list_sales_orders_deep_page": _page(ORDERS_BASE, "order_date DESC, id DESC", 120, 10),
    "list_audits_deep_page": _page(AUDITS_BASE, "timestamp DESC, id DESC", 3, 900),
    "list_products_collated_page": _page(PRODUCTS_BASE, "sku COLLATE es, id", 3, 40),
    "list_clients_page": _page("SELECT " + CLIENT + " FROM clients c WHERE c.is_active = TRUE",
                               "name, id", 10 ** 6, 10),
})
