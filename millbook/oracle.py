"""Independent DuckDB SQL for each registered query (the correctness oracle).

Each body reads the ERP tables by name; :func:`oracle_sql` prefixes the CTEs
that derive them from the driver views (the same fixture text Spark runs).
Decimals are presented as DOUBLE and dates as TIMESTAMP, matching
``millbook.plans.portable``.
"""

from __future__ import annotations

from millbook.sources.fixtures import duckdb_ctes

AS_OF = "DATE '2001-07-20'"
FULL = "BETWEEN DATE '1990-01-01' AND DATE '2030-12-31'"
RANGE = "BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"


def _d(expr: str) -> str:
    """decimal -> DECIMAL(18,2) -> DOUBLE, as the Spark side reports sums."""
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS DOUBLE)"


def _rounded(num: str, den: str, places: int) -> str:
    """``num / den`` half-up to ``places``, in whole hundredths (nothing negative)."""
    n, d = f"CAST(({num}) * 100 AS HUGEINT) * {10 ** places}", f"CAST(({den}) * 100 AS HUGEINT)"
    return f"CAST((2 * {n} + {d}) // nullif(2 * {d}, 0) AS DOUBLE) / {10 ** places}"


def _sales_by_client(extra: str = "") -> str:
    return f"""
SELECT c.id AS client_id, c.name AS client_name, count(so.id) AS total_orders,
       {_d('sum(so.total)')} AS total_sales
FROM clients c JOIN sales_orders so ON c.id = so.client_id
WHERE so.status = 'COMPLETED' {extra}
GROUP BY c.id, c.name"""


def _sales_over_time(cond: str, bucket: str) -> str:
    return f"""
SELECT CAST({bucket} AS TIMESTAMP) AS date, {_d('sum(total)')} AS total_sales
FROM sales_orders WHERE status = 'COMPLETED' AND {cond}
GROUP BY 1"""


def _kpis(cond: str) -> str:
    return f"""
SELECT {_d('sum(total)')} AS total_revenue, count(id) AS total_orders,
       {_rounded('sum(total)', 'count(id)', 6)} AS average_order_value
FROM sales_orders WHERE status = 'COMPLETED' AND {cond}"""


def _top_clients(cond: str) -> str:
    return f"""
SELECT c.name AS client_name, {_d('sum(so.total)')} AS total_sales
FROM sales_orders so JOIN clients c ON so.client_id = c.id
WHERE so.status = 'COMPLETED' AND {cond}
GROUP BY c.name ORDER BY sum(so.total) DESC, c.name LIMIT 5"""


def _to_fixed(x: str) -> str:
    """toFixed(2): printf rounds the exact value too, but halves (odd eighths) to even instead of up; nothing negative here."""
    return (f"CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN 'Infinity' "
            f"WHEN ({x}) * 8 = floor(({x}) * 8) AND ({x}) * 8 % 2 = 1 THEN printf('%.2f', ({x}) + 0.001) "
            f"ELSE printf('%.2f', {x}) END")


LATEST_COSTS = """
SELECT c.product_id, c.total AS product_cost, c.calculation_date
FROM costings c JOIN (SELECT product_id, max(calculation_date) AS last_date FROM costings GROUP BY product_id) m
  ON m.product_id = c.product_id AND m.last_date = c.calculation_date"""


def _profit(extra: str = "") -> str:
    return f"""
WITH lc AS ({LATEST_COSTS})
SELECT c.id AS client_id, c.name AS client_name, count(DISTINCT so.id) AS total_orders,
       {_d('sum(op.quantity * op.price)')} AS total_revenue,
       {_d('sum(op.quantity * coalesce(lc.product_cost, 0))')} AS total_cost,
       {_d('sum(op.quantity * op.price) - sum(op.quantity * coalesce(lc.product_cost, 0))')} AS total_profit
FROM sales_orders so JOIN clients c ON so.client_id = c.id
JOIN order_products op ON so.id = op.order_id
LEFT JOIN lc ON op.product_id = lc.product_id
WHERE so.status = 'COMPLETED' {extra}
GROUP BY c.id, c.name"""


BODIES: dict[str, str] = {
    "sales_by_client": _sales_by_client(),
    "sales_by_client_range": _sales_by_client(f"AND so.order_date {RANGE}"),
    "sales_over_time": _sales_over_time(f"order_date >= {AS_OF} - INTERVAL '7 days'", "date_trunc('day', order_date)"),
    "sales_over_time_today": _sales_over_time(f"order_date >= {AS_OF}", "date_trunc('hour', created_at)"),
    "sales_over_time_weekly": _sales_over_time(f"order_date >= date_trunc('week', {AS_OF})", "date_trunc('day', order_date)"),
    "sales_over_time_monthly": _sales_over_time(f"order_date >= date_trunc('month', {AS_OF})", "date_trunc('day', order_date)"),
    "sales_over_time_yearly": _sales_over_time(f"order_date >= date_trunc('year', {AS_OF})", "date_trunc('month', order_date)"),
    "sales_over_time_range": _sales_over_time(f"order_date {FULL}", "date_trunc('day', order_date)"),
    "sales_kpis": _kpis(f"order_date {FULL}"),
    "sales_kpis_monthly": _kpis(f"order_date >= date_trunc('month', {AS_OF})"),
    "top_clients": _top_clients(f"so.order_date {FULL}"),
    "waste_by_process": f"""
SELECT process, {_d('sum(quantity)')} AS total_waste FROM wastes GROUP BY process""",
    "waste_by_process_range": f"""
SELECT process, {_d('sum(quantity)')} AS total_waste FROM wastes
WHERE date >= DATE '1996-01-01' AND date <= DATE '1999-01-01' GROUP BY process""",
    "production_cost_analysis": f"""
WITH m AS (SELECT pc.order_id, sum(pc.consumed_quantity * p.cost_price) AS mat
           FROM production_consumptions pc JOIN products p ON pc.material_id = p.id GROUP BY pc.order_id),
     w AS (SELECT order_id, sum(quantity) AS kg FROM wastes GROUP BY order_id),
     base AS (
       SELECT po.id AS order_id, po.order_number, po.product_id, po.quantity AS quantity_produced,
              p.cost_price AS manufactured_product_cost_estimate,
              CAST(coalesce(m.mat, 0) AS DECIMAL(18,2)) AS material_cost,
              CAST(coalesce(w.kg, 0) * 25.00 AS DECIMAL(18,2)) AS waste_cost
       FROM production_orders po JOIN products p ON po.product_id = p.id
       LEFT JOIN m ON m.order_id = po.id LEFT JOIN w ON w.order_id = po.id)
SELECT order_id, order_number, product_id, CAST(quantity_produced AS DOUBLE) AS quantity_produced,
       CAST(manufactured_product_cost_estimate AS DOUBLE) AS manufactured_product_cost_estimate,
       CAST(material_cost AS DOUBLE) AS material_cost, CAST(0 AS DOUBLE) AS labor_cost,
       CAST(waste_cost AS DOUBLE) AS waste_cost,
       {_d('material_cost + waste_cost')} AS total_cost,
       {_rounded('material_cost + waste_cost', 'quantity_produced', 2)} AS cost_per_unit
FROM base""",
    "production_cost_texts": f"""
WITH m AS (SELECT pc.order_id, sum(pc.consumed_quantity * p.cost_price) AS mat
           FROM production_consumptions pc JOIN products p ON pc.material_id = p.id GROUP BY pc.order_id),
     w AS (SELECT order_id, sum(quantity) AS kg FROM wastes GROUP BY order_id),
     base AS (
       SELECT po.id AS order_id, po.order_number, po.product_id, CAST(po.quantity AS DOUBLE) AS quantity_produced,
              coalesce(CAST(m.mat AS DOUBLE), 0) AS mat, coalesce(CAST(w.kg AS DOUBLE), 0) * 25.0::DOUBLE AS waste
       FROM production_orders po JOIN products p ON po.product_id = p.id
       LEFT JOIN m ON m.order_id = po.id LEFT JOIN w ON w.order_id = po.id),
     unit AS (SELECT *, mat + waste AS total,
                     CASE WHEN coalesce(quantity_produced, 0) <> 0 THEN (mat + waste) / quantity_produced
                          WHEN mat + waste > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS per FROM base)
SELECT order_id, order_number, product_id, quantity_produced, {_to_fixed('mat')} AS material_cost, '0.00' AS labor_cost,
       {_to_fixed('waste')} AS waste_cost, {_to_fixed('total')} AS total_cost, {_to_fixed('per')} AS cost_per_unit
FROM unit""",
    "profit_by_client": _profit(),
    "profit_by_client_range": _profit(f"AND so.order_date {RANGE}"),
    "latest_costs": f"""
SELECT product_id, CAST(product_cost AS DOUBLE) AS product_cost,
       CAST(calculation_date AS TIMESTAMP) AS calculation_date FROM ({LATEST_COSTS}) x""",
    "payroll_report": """
WITH er AS (SELECT id, name, position, salary, CAST(salary * 0.00625 AS DECIMAL(17,7)) AS hourly_rate
            FROM employees WHERE is_active = TRUE),
     pd AS (SELECT employee_id, sum(coalesce(overtime_hours, 0)) AS toh,
                   count(*) FILTER (WHERE absence_reason IS NOT NULL) AS tad
            FROM attendances WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' GROUP BY employee_id)
SELECT e.id AS employee_id, e.name AS employee_name, e.position, CAST(e.salary AS DOUBLE) AS base_salary,
       CAST(e.hourly_rate AS DOUBLE) AS hourly_rate,
       CAST(CAST(coalesce(p.toh, 0) AS DECIMAL(18,2)) AS DOUBLE) AS total_overtime_hours,
       CAST(CAST(coalesce(p.toh, 0) * 2 AS DECIMAL(14,2)) * e.hourly_rate AS DOUBLE) AS overtime_pay,
       coalesce(p.tad, 0) AS total_absence_days,
       CAST(CAST(coalesce(p.tad, 0) * 8 AS DECIMAL(12,0)) * e.hourly_rate AS DOUBLE) AS absence_deduction,
       CAST(e.salary + CAST(coalesce(p.toh, 0) * 2 AS DECIMAL(14,2)) * e.hourly_rate
            - CAST(coalesce(p.tad, 0) * 8 AS DECIMAL(12,0)) * e.hourly_rate AS DOUBLE) AS total_pay
FROM er e LEFT JOIN pd p ON e.id = p.employee_id""",
    "client_outstanding_balance": f"""
WITH bal AS (SELECT so.client_id, sum(so.total) AS s FROM sales_orders so
             JOIN invoices i ON so.id = i.order_id WHERE i.status IN ('PENDING', 'OVERDUE') GROUP BY so.client_id)
SELECT c.id AS client_id, CAST(c.credit_limit AS DOUBLE) AS credit_limit,
       {_d('coalesce(bal.s, 0)')} AS outstanding_balance
FROM clients c LEFT JOIN bal ON bal.client_id = c.id""",
    "dashboard_kpis": f"""
SELECT {_d(f"coalesce((SELECT sum(total) FROM sales_orders WHERE status = 'COMPLETED' AND order_date >= date_trunc('month', {AS_OF})), 0)")} AS total_sales_month,
       (SELECT count(id) FROM sales_orders WHERE order_date = {AS_OF}) AS new_orders_today,
       (SELECT count(id) FROM production_orders WHERE status = 'IN_PROGRESS') AS orders_in_progress,
       (SELECT count(id) FROM products WHERE current_stock <= min_stock AND is_active = TRUE) AS low_stock_items,
       {_d(f"coalesce((SELECT sum(amount) FROM incomes WHERE date >= date_trunc('month', {AS_OF})), 0)")} AS total_incomes_month,
       {_d(f"coalesce((SELECT sum(amount) FROM expenses WHERE date >= date_trunc('month', {AS_OF})), 0)")} AS total_expenses_month""",
    "critical_stock_top5": """
SELECT id, sku, description, CAST(current_stock AS DOUBLE) AS current_stock, CAST(min_stock AS DOUBLE) AS min_stock
FROM products WHERE current_stock <= min_stock AND is_active = TRUE
ORDER BY current_stock - min_stock, id LIMIT 5""",
    "pending_quotes_top5": """
SELECT so.id, so.order_number, c.name AS client_name, CAST(so.total AS DOUBLE) AS total
FROM sales_orders so JOIN clients c ON so.client_id = c.id WHERE so.status = 'QUOTE'
ORDER BY so.order_date DESC, so.id DESC LIMIT 5""",
    "active_production_top5": """
SELECT po.id, po.order_number, p.description AS product_description, CAST(po.quantity AS DOUBLE) AS quantity
FROM production_orders po JOIN products p ON po.product_id = p.id WHERE po.status = 'IN_PROGRESS'
ORDER BY po.planned_start_date, po.id LIMIT 5""",
    "top_clients_month": _top_clients(f"so.order_date >= date_trunc('month', {AS_OF})"),
    "notification_counts": """
SELECT (SELECT count(id) FROM products WHERE current_stock <= min_stock AND is_active = TRUE) AS low_stock_count,
       (SELECT count(id) FROM sales_orders WHERE status = 'QUOTE') AS pending_quotes_count,
       (SELECT count(id) FROM production_orders WHERE status = 'PENDING') AS pending_production_count""",
}


def oracle_sql() -> dict[str, str]:
    from millbook import oracle_listings, oracle_changes  # noqa: F401  (extend BODIES)
    out = {}
    for name, body in BODIES.items():
        ctes = duckdb_ctes(body)
        out[name] = f"{ctes}SELECT * FROM ({body.strip()}) AS q" if ctes else body.strip()
    return out
