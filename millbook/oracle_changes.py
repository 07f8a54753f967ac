"""Oracle SQL for the ledger and change-application queries."""

from __future__ import annotations

from millbook.oracle import BODIES

# Arrival-order fold as a recursive CTE: step k of a product applies its k-th request.
def fold_ctes(source: str, order: str,
              where: str = "m.quantity > 0 AND m.movement_type IN ('ENTRY', 'EXIT')") -> str:
    """CTEs src, r, f, d (to follow WITH RECURSIVE): d has each request with before/after/accepted."""
    return f"""
 src AS ({source}),
 r AS (SELECT m.*, CAST(coalesce(p.current_stock, 0) AS DECIMAL(18,2)) AS stock0,
              row_number() OVER (PARTITION BY m.product_id ORDER BY {order}) AS rn
       FROM src m JOIN products p ON m.product_id = p.id
       WHERE {where}),
 f AS (SELECT product_id, rn, stock0 AS before,
              CAST(CASE WHEN movement_type = 'ENTRY' THEN stock0 + quantity
                        WHEN stock0 >= quantity THEN stock0 - quantity ELSE stock0 END AS DECIMAL(18,2)) AS after
       FROM r WHERE rn = 1
       UNION ALL
       SELECT r.product_id, r.rn, f.after,
              CAST(CASE WHEN r.movement_type = 'ENTRY' THEN f.after + r.quantity
                        WHEN f.after >= r.quantity THEN f.after - r.quantity ELSE f.after END AS DECIMAL(18,2))
       FROM f JOIN r ON r.product_id = f.product_id AND r.rn = f.rn + 1),
 d AS (SELECT r.*, f.before, f.after, (r.movement_type = 'ENTRY' OR f.before >= r.quantity) AS accepted
       FROM r JOIN f ON r.product_id = f.product_id AND r.rn = f.rn)"""


def movement_fold(source: str, order: str) -> str:
    return "\nWITH RECURSIVE" + fold_ctes(source, order) + "\n"


MOVEMENT_FOLD = movement_fold(
    "SELECT * FROM movement_requests",
    "m.requested_at, m.request_id, m.movement_type, m.quantity, m.user_id, m.reference_document")

BODIES.update({
    "apply_movements": MOVEMENT_FOLD + """
SELECT request_id, requested_at, product_id, movement_type, CAST(quantity AS DOUBLE) AS quantity, user_id,
       reference_document, accepted, CAST(before AS DOUBLE) AS stock_before, CAST(after AS DOUBLE) AS stock_after
FROM d""",
    "apply_movements_stock": MOVEMENT_FOLD + """,
 delta AS (SELECT product_id, sum(CASE WHEN movement_type = 'EXIT' THEN -quantity ELSE quantity END) AS dq
           FROM d WHERE accepted GROUP BY product_id)
SELECT p.id, p.sku, p.description, p.type, p.unit, CAST(p.cost_price AS DOUBLE) AS cost_price,
       CAST(p.min_stock AS DOUBLE) AS min_stock,
       CAST(CASE WHEN delta.dq IS NULL THEN p.current_stock
                 ELSE CAST(coalesce(p.current_stock, 0) + delta.dq AS DECIMAL(12,2)) END AS DOUBLE) AS current_stock,
       CAST(p.supplier_id AS DOUBLE) AS supplier_id, p.is_active
FROM products p LEFT JOIN delta ON delta.product_id = p.id""",
    "apply_movements_rejects": MOVEMENT_FOLD + """
SELECT request_id, product_id, 'INSUFFICIENT_STOCK' AS reason FROM d WHERE NOT accepted
UNION ALL
SELECT m.request_id, m.product_id,
       CASE WHEN p.id IS NULL THEN 'PRODUCT_NOT_FOUND'
            WHEN m.movement_type IS NULL OR m.movement_type NOT IN ('ENTRY', 'EXIT') THEN 'INVALID_MOVEMENT_TYPE'
            ELSE 'NON_POSITIVE_QUANTITY' END AS reason
FROM movement_requests m LEFT JOIN products p ON m.product_id = p.id
WHERE p.id IS NULL OR m.movement_type IS NULL OR m.movement_type NOT IN ('ENTRY', 'EXIT')
   OR m.quantity IS NULL OR m.quantity <= 0""",
    "kardex": """
SELECT product_id, movement_type, CAST(quantity AS DOUBLE) AS quantity, moved_at, reference_id, line_no,
       CAST(CAST(closing - quantity AS DECIMAL(18,2)) AS DOUBLE) AS opening_balance,
       CAST(CAST(closing AS DECIMAL(18,2)) AS DOUBLE) AS closing_balance
FROM (SELECT *, sum(quantity) OVER (PARTITION BY product_id ORDER BY moved_at NULLS FIRST, reference_id NULLS FIRST,
                                             line_no NULLS FIRST, quantity
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closing
      FROM inventory_movements) x""",
    "ledger_balance": """
SELECT product_id, CAST(CAST(sum(quantity) AS DECIMAL(18,2)) AS DOUBLE) AS ledger_stock
FROM inventory_movements GROUP BY product_id""",
})

# Unique keys of users, in the order of checking.
_KEYS = (("username", "DUPLICATE_USERNAME"), ("email", "DUPLICATE_EMAIL"), ("employee_id", "DUPLICATE_EMPLOYEE"))


def _user_steps(requests: str, holder: str) -> str:
    """CTEs q, run, told (to follow WITH RECURSIVE): ``requests`` applied to the users one at a time.

    The keyed rows are every user's keys, the turn (key -1) and each request's
    outcome (key -1 - turn): 0 accepted, else the first key another user holds.
    """
    hit = " ".join(f"WHEN u.{k} = t.{k} THEN {i}" for i, (k, _) in enumerate(_KEYS, 1))
    any_hit = " OR ".join(f"u.{k} = t.{k}" for k, _ in _KEYS)
    names = " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, reason) in enumerate(_KEYS, 1))
    return f"""
 q AS MATERIALIZED (SELECT x.*, {holder} AS holder FROM (
        SELECT r.*, row_number() OVER (ORDER BY requested_at, request_id) AS k FROM ({requests}) r) x),
 run(key, username, email, employee_id, code, k) USING KEY (key) AS (
   SELECT id, username, email, employee_id, 0, CAST(0 AS BIGINT) FROM users
   UNION ALL SELECT -1, NULL, NULL, NULL, 0, 0
   UNION
   (WITH now AS (SELECT r.k + 1 AS k FROM run r WHERE r.key = -1),
         t AS (SELECT q.* FROM q JOIN now ON q.k = now.k),
         o AS (SELECT t.k, coalesce(min(CASE {hit} END), 0) AS code
               FROM t LEFT JOIN recurring.run u ON (u.key >= 0 OR u.key < -1000000000) AND u.key <> t.holder AND ({any_hit})
               GROUP BY t.k)
    SELECT -1, NULL, NULL, NULL, 0, k FROM now WHERE k <= (SELECT max(k) FROM q)
    UNION ALL SELECT -1 - k, NULL, NULL, NULL, code, k FROM o
    UNION ALL SELECT t.holder, t.username, t.email, t.employee_id, 0, t.k FROM t JOIN o ON o.k = t.k WHERE o.code = 0)),
 told AS (SELECT q.*, CASE run.code {names} END AS reason FROM q JOIN run ON run.key = -1 - q.k)"""


_USER_STEPS = _user_steps("SELECT * FROM user_updates WHERE id IN (SELECT id FROM users)", "x.id")

NOW = "TIMESTAMP '2001-07-20 00:00:00'"
PRODUCT_OUT = ("CAST(cost_price AS DOUBLE) AS cost_price, CAST(min_stock AS DOUBLE) AS min_stock, "
               "CAST(current_stock AS DOUBLE) AS current_stock, CAST(supplier_id AS DOUBLE) AS supplier_id")


def _latest_set(col: str) -> str:
    """Latest supplied value of a column per client (partial updates)."""
    return (f"arg_max_null({col}, {{'a': requested_at, 'b': request_id}}) FILTER (WHERE list_contains(s, '{col}')) AS n_{col}, "
            f"bool_or(list_contains(s, '{col}')) AS h_{col}")


def _pick(col: str) -> str:
    return f"CASE WHEN coalesce(a.h_{col}, FALSE) THEN a.n_{col} ELSE c.{col} END"


PRODUCT_OK = """
WITH ok1 AS (SELECT * FROM product_requests WHERE sku IS NOT NULL),
     firsts AS (SELECT sku, min({'a': requested_at, 'b': request_id}) AS f FROM ok1 GROUP BY sku),
     ok AS (SELECT ok1.* FROM ok1 JOIN firsts ON ok1.sku = firsts.sku
            WHERE {'a': ok1.requested_at, 'b': ok1.request_id} = firsts.f
              AND ok1.sku NOT IN (SELECT sku FROM products WHERE sku IS NOT NULL))"""

BODIES.update({
    "append_products": PRODUCT_OK + f"""
SELECT (SELECT coalesce(max(id), 0) FROM products)
         + row_number() OVER (ORDER BY requested_at, request_id, user_id, sku, description, type, unit,
                                       cost_price, min_stock, supplier_id) AS id,
       sku, description, coalesce(nullif(type, ''), 'FINISHED_PRODUCT') AS type, unit,
       CAST(cost_price AS DOUBLE) AS cost_price, CAST(coalesce(nullif(min_stock, 0), 0) AS DOUBLE) AS min_stock,
       CAST(0 AS DOUBLE) AS current_stock, CAST(supplier_id AS DOUBLE) AS supplier_id, TRUE AS is_active,
       requested_at, request_id
FROM ok""",
    "append_products_rejects": """
SELECT request_id, 'REQUIRED_FIELD_MISSING:sku' AS reason FROM product_requests WHERE sku IS NULL
UNION ALL
SELECT r.request_id, 'DUPLICATE_SKU' AS reason FROM product_requests r
WHERE r.sku IS NOT NULL AND (r.sku IN (SELECT sku FROM products WHERE sku IS NOT NULL)
   OR {'a': r.requested_at, 'b': r.request_id} <>
      (SELECT min({'a': q.requested_at, 'b': q.request_id}) FROM product_requests q WHERE q.sku = r.sku))""",
    "append_production_orders": """
WITH ok AS (SELECT * FROM production_order_requests
            WHERE quantity > 0 AND product_id IN (SELECT id FROM products)),
     num AS (SELECT ok.*, (SELECT coalesce(max(id), 0) FROM production_orders)
                + row_number() OVER (ORDER BY requested_at, request_id, product_id, quantity,
                                              planned_start_date, planned_end_date, priority) AS id FROM ok)
SELECT id, concat('OP-20010720-', CAST(id AS VARCHAR)) AS order_number, product_id, CAST(quantity AS DOUBLE) AS quantity,
       'PENDING' AS status, coalesce(nullif(priority, ''), 'MEDIUM') AS priority,
       CAST(planned_start_date AS TIMESTAMP) AS planned_start_date,
       CAST(planned_end_date AS TIMESTAMP) AS planned_end_date, requested_at, request_id
FROM num""",
    "append_wastes": f"""
WITH ok AS (SELECT * FROM waste_requests WHERE order_id IN (SELECT id FROM production_orders) AND quantity > 0
              AND process IN ('EXTRUSION', 'BLOWING'))
SELECT (SELECT coalesce(max(id), 0) FROM wastes)
         + row_number() OVER (ORDER BY requested_at, request_id, order_id, process, quantity, reason) AS id,
       order_id, process, CAST(quantity AS DOUBLE) AS quantity, reason, {NOW} AS date, requested_at, request_id
FROM ok""",
    "apply_client_updates": f"""
WITH ch AS (SELECT u.*, string_split(coalesce(u.set_columns, ''), ',') AS s FROM client_updates u
            WHERE u.id IN (SELECT id FROM clients WHERE is_active = TRUE)),
     a AS (SELECT id, {_latest_set('name')}, {_latest_set('address')}, {_latest_set('credit_limit')},
                  {_latest_set('payment_terms')} FROM ch GROUP BY id)
SELECT c.id, c.code, {_pick('name')} AS name, {_pick('address')} AS address,
       CAST({_pick('credit_limit')} AS DOUBLE) AS credit_limit, {_pick('payment_terms')} AS payment_terms,
       c.is_active,
       CASE WHEN coalesce(a.h_name OR a.h_address OR a.h_credit_limit OR a.h_payment_terms, FALSE)
            THEN {NOW} END AS updated_at
FROM clients c LEFT JOIN a ON a.id = c.id""",
    "apply_client_updates_rejects": """
SELECT request_id, 'NOT_FOUND' AS reason FROM client_updates
WHERE id NOT IN (SELECT id FROM clients WHERE is_active = TRUE)""",
    "update_users": f"""
WITH RECURSIVE {_USER_STEPS.lstrip()},
     l AS (SELECT id, arg_max({{'username': username, 'email': email, 'role': role, 'employee_id': employee_id,
                               'is_active': is_active}}, {{'a': requested_at, 'b': request_id}}) AS n
           FROM told WHERE reason IS NULL GROUP BY id)
SELECT u.id,
       CAST(CASE WHEN l.id IS NULL THEN u.employee_id ELSE l.n.employee_id END AS DOUBLE) AS employee_id,
       CASE WHEN l.id IS NULL THEN u.username ELSE l.n.username END AS username,
       CASE WHEN l.id IS NULL THEN u.email ELSE l.n.email END AS email,
       CASE WHEN l.id IS NULL THEN u.role ELSE l.n.role END AS role,
       CASE WHEN l.id IS NULL THEN u.is_active ELSE l.n.is_active END AS is_active, u.last_login,
       CASE WHEN l.id IS NOT NULL THEN {NOW} END AS updated_at
FROM users u LEFT JOIN l ON l.id = u.id""",
    "soft_delete_products": f"""
WITH hit AS (SELECT DISTINCT d.id FROM product_deletes d JOIN products p ON p.id = d.id AND p.is_active = TRUE)
SELECT p.id, p.sku, p.description, p.type, p.unit, {PRODUCT_OUT},
       CASE WHEN hit.id IS NOT NULL THEN FALSE ELSE p.is_active END AS is_active,
       CASE WHEN hit.id IS NOT NULL THEN {NOW} END AS updated_at
FROM products p LEFT JOIN hit ON hit.id = p.id""",
    "soft_delete_products_rejects": """
SELECT request_id, 'NOT_FOUND' AS reason FROM product_deletes
WHERE id NOT IN (SELECT id FROM products WHERE is_active = TRUE)""",
    "soft_delete_clients": f"""
WITH hit AS (SELECT DISTINCT d.id FROM client_deletes d JOIN clients c ON c.id = d.id)
SELECT c.id, c.code, c.name, c.address, CAST(c.credit_limit AS DOUBLE) AS credit_limit, c.payment_terms,
       CASE WHEN hit.id IS NOT NULL THEN FALSE ELSE c.is_active END AS is_active,
       CASE WHEN hit.id IS NOT NULL THEN {NOW} END AS updated_at
FROM clients c LEFT JOIN hit ON hit.id = c.id""",
    "hard_delete_shifts": """
SELECT id, employee_id, CAST(date AS TIMESTAMP) AS date, machine, CAST(duration AS DOUBLE) AS duration
FROM shifts WHERE id NOT IN (SELECT id FROM shift_deletes)""",
    "hard_delete_shifts_rejects": """
SELECT request_id, 'NOT_FOUND' AS reason FROM shift_deletes WHERE id NOT IN (SELECT id FROM shifts)""",
    "upsert_attendance": """
WITH ch AS (SELECT request_id, requested_at, employee_id, date, entry_time, exit_time,
                   nullif(absence_reason, '') AS absence_reason, nullif(overtime_hours, 0) AS overtime_hours
            FROM attendance_changes WHERE coalesce(employee_id, 0) <> 0 AND date IS NOT NULL),
     c AS (SELECT employee_id, date, min({'a': requested_at, 'b': request_id}) AS first,
                  arg_max(entry_time, {'a': requested_at, 'b': request_id}) FILTER (WHERE entry_time IS NOT NULL) AS n_entry,
                  arg_max(exit_time, {'a': requested_at, 'b': request_id}) FILTER (WHERE exit_time IS NOT NULL) AS n_exit,
                  arg_max(absence_reason, {'a': requested_at, 'b': request_id}) FILTER (WHERE absence_reason IS NOT NULL) AS n_abs,
                  arg_max(overtime_hours, {'a': requested_at, 'b': request_id}) FILTER (WHERE overtime_hours IS NOT NULL) AS n_ot
           FROM ch GROUP BY employee_id, date),
     m AS (SELECT coalesce(a.employee_id, c.employee_id) AS employee_id, coalesce(a.date, c.date) AS date, a.id,
                  coalesce(c.n_entry, a.entry_time) AS entry_time, coalesce(c.n_exit, a.exit_time) AS exit_time,
                  coalesce(c.n_abs, a.absence_reason) AS absence_reason,
                  coalesce(c.n_ot, a.overtime_hours) AS overtime_hours, c.first
           FROM attendances a FULL OUTER JOIN c ON a.employee_id = c.employee_id AND a.date = c.date)
SELECT coalesce(id, (SELECT coalesce(max(id), 0) FROM attendances)
                    + row_number() OVER (PARTITION BY id IS NULL ORDER BY first)) AS id,
       employee_id, CAST(date AS TIMESTAMP) AS date, entry_time, exit_time, absence_reason,
       CAST(overtime_hours AS DOUBLE) AS overtime_hours
FROM m""",
    "sales_status_changes": f"""
WITH ok AS (SELECT * FROM sales_status_changes
            WHERE status IN ('CONFIRMED', 'IN_PROGRESS', 'COMPLETED', 'CANCELLED')
              AND id IN (SELECT id FROM sales_orders)),
     l AS (SELECT id, arg_max(status, {{'a': requested_at, 'b': request_id, 'c': status}}) AS st FROM ok GROUP BY id)
SELECT so.id, so.order_number, so.client_id, CAST(so.order_date AS TIMESTAMP) AS order_date, so.created_at,
       CAST(so.delivery_date AS TIMESTAMP) AS delivery_date, CAST(so.subtotal AS DOUBLE) AS subtotal,
       CAST(so.tax_amount AS DOUBLE) AS tax_amount, CAST(so.total AS DOUBLE) AS total, so.notes,
       coalesce(l.st, so.status) AS status, CASE WHEN l.st IS NOT NULL THEN {NOW} END AS updated_at
FROM sales_orders so LEFT JOIN l ON l.id = so.id""",
    "sales_status_changes_rejects": """
SELECT request_id, 'NOT_ALLOWED:status' AS reason FROM sales_status_changes
WHERE status IS NULL OR status NOT IN ('CONFIRMED', 'IN_PROGRESS', 'COMPLETED', 'CANCELLED')
UNION ALL
SELECT request_id, 'NOT_FOUND' AS reason FROM sales_status_changes
WHERE status IN ('CONFIRMED', 'IN_PROGRESS', 'COMPLETED', 'CANCELLED') AND id NOT IN (SELECT id FROM sales_orders)""",
    "intake_costings": """
SELECT request_id, product_id,
       CAST(coalesce(nullif(material_cost, 0), 0) AS DOUBLE) AS material_cost,
       CAST(coalesce(nullif(labor_cost, 0), 0) AS DOUBLE) AS labor_cost,
       CAST(coalesce(nullif(waste_cost, 0), 0) AS DOUBLE) AS waste_cost,
       CAST(CAST(coalesce(nullif(material_cost, 0), 0) + coalesce(nullif(labor_cost, 0), 0)
                 + coalesce(nullif(waste_cost, 0), 0) AS DECIMAL(12,2)) AS DOUBLE) AS total,
       CAST(calculation_date AS TIMESTAMP) AS calculation_date
FROM costing_requests WHERE product_id <> 0 AND calculation_date IS NOT NULL AND product_id IN (SELECT id FROM products)""",
    "intake_costings_rejects": """
SELECT request_id, CASE WHEN coalesce(product_id, 0) = 0 THEN 'REQUIRED_FIELD_MISSING:product_id'
                        WHEN calculation_date IS NULL THEN 'REQUIRED_FIELD_MISSING:calculation_date'
                        ELSE 'PRODUCT_NOT_FOUND' END AS reason
FROM costing_requests
WHERE coalesce(product_id, 0) = 0 OR calculation_date IS NULL OR product_id NOT IN (SELECT id FROM products)""",
})


def _sales_check_ctes() -> str:
    """CTEs priced, bal, lr, chk: the W11 reason per sales-order request."""
    sub = "pr.sub"
    tax = "CAST(pr.sub AS DECIMAL(18,4)) * 0.16"
    return f"""
     priced AS (SELECT request_id, sum(quantity * price) AS sub FROM sales_order_lines GROUP BY request_id),
     bal AS (SELECT c.id AS client_id, c.credit_limit, coalesce(b.s, 0) AS open
             FROM clients c LEFT JOIN (SELECT so.client_id, sum(so.total) AS s FROM sales_orders so
                                       JOIN invoices i ON so.id = i.order_id
                                       WHERE i.status IN ('PENDING', 'OVERDUE') GROUP BY so.client_id) b
             ON b.client_id = c.id),
     lr AS (SELECT l.request_id,
                   arg_min(CASE WHEN p.id IS NULL THEN 'PRODUCT_NOT_FOUND' ELSE 'INSUFFICIENT_STOCK' END,
                           {{'a': l.line_no, 'b': l.product_id, 'c': l.quantity, 'd': l.price}})
                     FILTER (WHERE p.id IS NULL OR coalesce(p.current_stock, 0) < l.quantity) AS r
            FROM sales_order_lines l LEFT JOIN products p ON p.id = l.product_id GROUP BY l.request_id),
     chk AS (
       SELECT h.request_id, h.requested_at, h.client_id, h.user_id, h.notes, h.delivery_date,
              CAST({sub} AS DECIMAL(18,2)) AS subtotal, CAST({tax} AS DECIMAL(18,2)) AS tax_amount,
              CAST({sub} + {tax} AS DECIMAL(18,2)) AS total, {sub} + {tax} AS total_exact,
              CASE WHEN pr.sub IS NULL THEN 'EMPTY_ORDER' WHEN b.client_id IS NULL THEN 'CLIENT_NOT_FOUND'
                   WHEN b.open + ({sub} + {tax}) > b.credit_limit THEN 'CREDIT_LIMIT_EXCEEDED'
                   ELSE lr.r END AS reason
       FROM sales_order_requests h LEFT JOIN priced pr ON pr.request_id = h.request_id
       LEFT JOIN bal b ON b.client_id = h.client_id LEFT JOIN lr ON lr.request_id = h.request_id)"""


# the headers' total order: arrival, then every other column
HEADER_ORDER = ("requested_at, request_id, client_id NULLS FIRST, user_id NULLS FIRST, notes NULLS FIRST, "
                "delivery_date NULLS FIRST")

ACCEPTED = f"""
     acc AS (SELECT chk.*, (SELECT coalesce(max(id), 0) FROM sales_orders)
                             + row_number() OVER (ORDER BY {HEADER_ORDER}) AS id
             FROM chk WHERE reason IS NULL)
"""


def _sales_check() -> str:
    return "\nWITH" + _sales_check_ctes() + "," + ACCEPTED


# Allocate mode: header checks, then unknown products, then lines claim stock in arrival order.
ALLOCATE = ("\nWITH RECURSIVE" + _sales_check_ctes() + """,
     cand AS (SELECT request_id, requested_at FROM chk
              WHERE reason IS NULL OR reason IN ('PRODUCT_NOT_FOUND', 'INSUFFICIENT_STOCK')),
     cl AS (SELECT l.*, cand.requested_at FROM sales_order_lines l JOIN cand ON cand.request_id = l.request_id),
     unknown AS (SELECT DISTINCT cl.request_id FROM cl LEFT JOIN products p ON p.id = cl.product_id
                 WHERE p.id IS NULL),""" + fold_ctes(
    """SELECT cl.request_id, cl.requested_at, cl.line_no, cl.product_id, 'EXIT' AS movement_type,
              cl.quantity, cl.price
       FROM cl WHERE cl.request_id NOT IN (SELECT request_id FROM unknown)""",
    "m.requested_at, m.request_id, m.line_no, m.quantity, m.price", where="TRUE") + """,
     sunk AS (SELECT request_id, bool_or(NOT accepted) AS s FROM d GROUP BY request_id),
     fin AS (SELECT chk.request_id, chk.requested_at, chk.client_id, chk.user_id, chk.notes, chk.delivery_date,
                    chk.subtotal, chk.tax_amount, chk.total,
                    CASE WHEN chk.reason IS NOT NULL AND chk.reason NOT IN ('PRODUCT_NOT_FOUND', 'INSUFFICIENT_STOCK')
                              THEN chk.reason
                         WHEN chk.request_id IN (SELECT request_id FROM unknown) THEN 'PRODUCT_NOT_FOUND'
                         WHEN sunk.s THEN 'INSUFFICIENT_STOCK' END AS reason
             FROM chk LEFT JOIN sunk ON sunk.request_id = chk.request_id),
     acc AS (SELECT fin.*, (SELECT coalesce(max(id), 0) FROM sales_orders)
                             + row_number() OVER (ORDER BY """ + HEADER_ORDER + """) AS id
             FROM fin WHERE reason IS NULL)
""")

# Exact mode: one step per order in arrival order. The keyed rows are the stock of every product, the turn (key -1)
# and each order's outcome (key -1 - turn): 1 accepted, 2 a line of an unknown product, 3 a line without stock.
EXACT = ("\nWITH RECURSIVE" + _sales_check_ctes() + """,
     cand AS (SELECT request_id, row_number() OVER (ORDER BY requested_at, request_id) AS k FROM chk
              WHERE reason IS NULL OR reason IN ('PRODUCT_NOT_FOUND', 'INSUFFICIENT_STOCK')),
     turns AS MATERIALIZED (
       SELECT c.k, list({'p': l.product_id, 'q': l.quantity} ORDER BY l.line_no, l.product_id, l.quantity, l.price) AS ls
       FROM sales_order_lines l JOIN cand c ON c.request_id = l.request_id GROUP BY c.k),
     run(key, val, k) USING KEY (key) AS (
       SELECT id, CAST(coalesce(current_stock, 0) AS DECIMAL(18,2)), CAST(0 AS BIGINT) FROM products
       UNION ALL SELECT -1, 0, 0
       UNION
       (WITH now AS (SELECT r.k + 1 AS k FROM run r WHERE r.key = -1),
             t AS (SELECT turns.k, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM turns JOIN now ON turns.k = now.k),
             s AS (SELECT t.k, t.i, t.l.p AS p, t.l.q AS q, r.val FROM t LEFT JOIN recurring.run r ON r.key = t.l.p),
             o AS (SELECT k, coalesce(arg_min(CASE WHEN val IS NULL THEN 2 ELSE 3 END, i)
                                      FILTER (WHERE val IS NULL OR q > val), 1) AS code FROM s GROUP BY k)
        SELECT -1, 0, k FROM now WHERE k <= (SELECT max(k) FROM cand)
        UNION ALL SELECT -1 - k, code, k FROM o
        UNION ALL SELECT s.p, any_value(s.val) - sum(s.q), s.k FROM s JOIN o ON o.k = s.k WHERE o.code = 1
                  GROUP BY s.p, s.k)),
     fin AS (SELECT chk.request_id, chk.requested_at, chk.client_id, chk.user_id, chk.notes, chk.delivery_date,
                    chk.subtotal, chk.tax_amount, chk.total,
                    CASE WHEN cand.k IS NULL THEN chk.reason WHEN run.val = 2 THEN 'PRODUCT_NOT_FOUND'
                         WHEN run.val = 3 THEN 'INSUFFICIENT_STOCK' END AS reason
             FROM chk LEFT JOIN cand ON cand.request_id = chk.request_id LEFT JOIN run ON run.key = -1 - cand.k),
     acc AS (SELECT fin.*, (SELECT coalesce(max(id), 0) FROM sales_orders)
                             + row_number() OVER (ORDER BY """ + HEADER_ORDER + """) AS id
             FROM fin WHERE reason IS NULL)
""")

ORDER_ROWS = """
SELECT id, concat('SO-20010720-', CAST(id AS VARCHAR)) AS order_number, client_id,
       TIMESTAMP '2001-07-20 00:00:00' AS order_date, CAST(subtotal AS DOUBLE) AS subtotal,
       CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(total AS DOUBLE) AS total, notes, user_id AS created_by,
       'QUOTE' AS status, CAST(delivery_date AS TIMESTAMP) AS delivery_date, requested_at, request_id
FROM acc"""


CONSUMPTION_FOLD = movement_fold(
    """SELECT c.request_id, c.requested_at, c.material_id AS product_id, 'EXIT' AS movement_type,
              c.consumed_quantity AS quantity, c.user_id, concat('Consumo OP: ', po.order_number) AS reference_document,
              c.order_id
       FROM consumption_requests c JOIN production_orders po ON po.id = c.order_id""",
    "m.requested_at, m.request_id, m.movement_type, m.quantity, m.user_id, m.reference_document, m.order_id")

BATCH_OK = """
WITH found AS (SELECT b.*, po.order_number, po.product_id FROM batch_requests b
               JOIN production_orders po ON po.id = b.order_id),
     valid AS (SELECT * FROM found WHERE coalesce(batch_number, '') <> '' AND quantity_produced > 0
                 AND product_id IN (SELECT id FROM products)),
     firsts AS (SELECT batch_number, min({'a': requested_at, 'b': request_id}) AS f FROM valid GROUP BY batch_number),
     ok AS (SELECT valid.* FROM valid JOIN firsts ON firsts.batch_number = valid.batch_number
            WHERE {'a': valid.requested_at, 'b': valid.request_id} = firsts.f
              AND valid.batch_number NOT IN (SELECT batch_number FROM production_batches WHERE batch_number IS NOT NULL))
"""

BODIES.update({
    "price_sales_orders": """
SELECT request_id, CAST(CAST(s AS DECIMAL(18,2)) AS DOUBLE) AS subtotal,
       CAST(CAST(CAST(s AS DECIMAL(18,4)) * 0.16 AS DECIMAL(18,2)) AS DOUBLE) AS tax_amount,
       CAST(CAST(s + CAST(s AS DECIMAL(18,4)) * 0.16 AS DECIMAL(18,2)) AS DOUBLE) AS total
FROM (SELECT request_id, sum(quantity * price) AS s FROM sales_order_lines GROUP BY request_id) x""",
    "check_sales_orders": _sales_check() + """
SELECT request_id, requested_at, client_id, user_id, notes, CAST(delivery_date AS TIMESTAMP) AS delivery_date,
       CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(total AS DOUBLE) AS total,
       CAST(total_exact AS DOUBLE) AS total_exact, reason
FROM chk""",
    "intake_sales_orders": _sales_check() + ORDER_ROWS,
    "intake_sales_orders_allocate": ALLOCATE + ORDER_ROWS,
    "intake_sales_orders_exact": EXACT + ORDER_ROWS,
    "intake_sales_orders_exact_rejects": EXACT + "SELECT request_id, reason FROM fin WHERE reason IS NOT NULL",
    "intake_sales_orders_exact_stock": EXACT + """
SELECT p.id, p.sku, p.description, p.type, p.unit, CAST(p.cost_price AS DOUBLE) AS cost_price,
       CAST(p.min_stock AS DOUBLE) AS min_stock,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM sales_order_lines l JOIN acc ON acc.request_id = l.request_id
                              WHERE l.product_id = p.id) THEN run.val ELSE p.current_stock END AS DOUBLE) AS current_stock,
       CAST(p.supplier_id AS DOUBLE) AS supplier_id, p.is_active
FROM products p JOIN run ON run.key = p.id""",
    "intake_sales_orders_lines": _sales_check() + """
SELECT acc.id AS order_id, l.product_id, CAST(l.quantity AS DOUBLE) AS quantity, CAST(l.price AS DOUBLE) AS price
FROM sales_order_lines l JOIN acc ON acc.request_id = l.request_id""",
    "intake_sales_orders_stock": _sales_check() + """,
     taken AS (SELECT l.product_id, sum(l.quantity) AS q FROM sales_order_lines l
               JOIN acc ON acc.request_id = l.request_id GROUP BY l.product_id)
SELECT p.id, p.sku, p.description, p.type, p.unit, CAST(p.cost_price AS DOUBLE) AS cost_price,
       CAST(p.min_stock AS DOUBLE) AS min_stock,
       CAST(CASE WHEN taken.q IS NULL THEN p.current_stock ELSE p.current_stock - taken.q END AS DOUBLE) AS current_stock,
       CAST(p.supplier_id AS DOUBLE) AS supplier_id, p.is_active
FROM products p LEFT JOIN taken ON taken.product_id = p.id""",
    "intake_consumptions": CONSUMPTION_FOLD + """
SELECT order_id, product_id AS material_id, CAST(quantity AS DOUBLE) AS consumed_quantity,
       TIMESTAMP '2001-07-20 00:00:00' AS date, request_id
FROM d WHERE accepted""",
    "intake_consumptions_rejects": CONSUMPTION_FOLD + """
SELECT request_id, 'INSUFFICIENT_STOCK' AS reason FROM d WHERE NOT accepted
UNION ALL
SELECT request_id, 'ORDER_NOT_FOUND' AS reason FROM consumption_requests
WHERE order_id NOT IN (SELECT id FROM production_orders)
UNION ALL
SELECT c.request_id, CASE WHEN p.id IS NULL THEN 'PRODUCT_NOT_FOUND' ELSE 'NON_POSITIVE_QUANTITY' END AS reason
FROM consumption_requests c JOIN production_orders po ON po.id = c.order_id
LEFT JOIN products p ON p.id = c.material_id
WHERE p.id IS NULL OR c.consumed_quantity IS NULL OR c.consumed_quantity <= 0""",
    "intake_batches": BATCH_OK + """
SELECT batch_number, order_id, coalesce(production_date, TIMESTAMP '2001-07-20 00:00:00') AS production_date,
       coalesce(nullif(quality, ''), 'RELEASED') AS quality, request_id
FROM ok""",
    "intake_batches_movements": BATCH_OK + """
SELECT product_id, 'ENTRY' AS movement_type, CAST(quantity_produced AS DOUBLE) AS quantity,
       coalesce(production_date, TIMESTAMP '2001-07-20 00:00:00') AS moved_at, request_id AS reference_id,
       CAST(NULL AS DOUBLE) AS line_no, user_id,
       concat('Producción OP: ', order_number, ' / Lote: ', batch_number) AS reference_document,
       CAST(NULL AS VARCHAR) AS notes, batch_number AS batch, request_id
FROM ok""",
    "intake_batches_rejects": BATCH_OK + """
SELECT request_id, 'ORDER_NOT_FOUND' AS reason FROM batch_requests WHERE order_id NOT IN (SELECT id FROM production_orders)
UNION ALL
SELECT request_id, CASE WHEN coalesce(batch_number, '') = '' THEN 'REQUIRED_FIELD_MISSING:batch_number'
                        WHEN product_id NOT IN (SELECT id FROM products) THEN 'PRODUCT_NOT_FOUND'
                        WHEN quantity_produced IS NULL OR quantity_produced <= 0 THEN 'NON_POSITIVE_QUANTITY'
                        ELSE 'DUPLICATE_BATCH_NUMBER' END AS reason
FROM found WHERE (requested_at, request_id) NOT IN (SELECT requested_at, request_id FROM ok)""",
})

BODIES.update({
    "stream_stock_balance": BODIES["ledger_balance"],
    "stream_audit_log": "SELECT id, user_id, action, details, timestamp FROM audits",
})


def _numbered(source: str, table: str, order: str) -> str:
    return (f"(SELECT coalesce(max(id), 0) FROM {table}) + row_number() OVER (ORDER BY {order}) AS id")


def _latest_col(col: str) -> str:
    return _latest_set(col)


def _pick_col(alias: str, col: str) -> str:
    return f"CASE WHEN coalesce(a.h_{col}, FALSE) THEN a.n_{col} ELSE {alias}.{col} END"


BODIES.update({
    "append_clients": f"""
WITH firsts AS (SELECT code, min({{'a': requested_at, 'b': request_id}}) AS f FROM client_requests
                WHERE code IS NOT NULL GROUP BY code),
     ok AS (SELECT r.* FROM client_requests r LEFT JOIN firsts ON firsts.code = r.code
            WHERE r.code IS NULL OR ({{'a': r.requested_at, 'b': r.request_id}} = firsts.f
                                     AND r.code NOT IN (SELECT code FROM clients WHERE code IS NOT NULL)))
SELECT {_numbered('ok', 'clients', 'requested_at, request_id, code NULLS FIRST, name NULLS FIRST, address NULLS FIRST, credit_limit NULLS FIRST, payment_terms NULLS FIRST')},
       code, name, address, CAST(coalesce(nullif(credit_limit, 0), 0) AS DOUBLE) AS credit_limit,
       CAST(coalesce(nullif(payment_terms, 0), 30) AS INTEGER) AS payment_terms, TRUE AS is_active,
       requested_at, request_id
FROM ok""",
    "append_employees": f"""
SELECT {_numbered('employee_requests', 'employees', 'requested_at, request_id')},
       name, position, coalesce(nullif(shift, ''), 'MORNING') AS shift, CAST(hire_date AS TIMESTAMP) AS hire_date,
       CAST(nullif(salary, 0) AS DOUBLE) AS salary, TRUE AS is_active, requested_at, request_id
FROM employee_requests""",
    "append_incomes": f"""
SELECT {_numbered('income_requests', 'incomes', 'requested_at, request_id')},
       CAST(amount AS DOUBLE) AS amount, CAST(date AS TIMESTAMP) AS date, source,
       CAST(nullif(invoice_id, 0) AS DOUBLE) AS invoice_id, requested_at, request_id
FROM income_requests WHERE amount > 0 AND date IS NOT NULL AND coalesce(source, '') <> ''""",
    "append_expenses": f"""
SELECT {_numbered('expense_requests', 'expenses', 'requested_at, request_id, amount NULLS FIRST, date NULLS FIRST, category NULLS FIRST, nullif(supplier_id, 0) NULLS FIRST')},
       CAST(amount AS DOUBLE) AS amount, CAST(date AS TIMESTAMP) AS date, category,
       CAST(nullif(supplier_id, 0) AS DOUBLE) AS supplier_id, requested_at, request_id
FROM expense_requests WHERE amount > 0 AND date IS NOT NULL AND coalesce(category, '') <> ''""",
    "append_shifts": f"""
SELECT {_numbered('shift_requests', 'shifts', 'requested_at, request_id')},
       employee_id, CAST(date AS TIMESTAMP) AS date, machine, CAST(duration AS DOUBLE) AS duration,
       requested_at, request_id
FROM shift_requests WHERE duration > 0 AND coalesce(employee_id, 0) <> 0 AND date IS NOT NULL""",
    "apply_product_updates": f"""
WITH ch AS (SELECT u.*, string_split(coalesce(u.set_columns, ''), ',') AS s FROM product_updates u
            WHERE u.id IN (SELECT id FROM products WHERE is_active = TRUE)),
     a AS (SELECT id, {_latest_col('description')}, {_latest_col('cost_price')}, {_latest_col('min_stock')},
                  {_latest_col('current_stock')}, {_latest_col('supplier_id')} FROM ch GROUP BY id)
SELECT p.id, p.sku, {_pick_col('p', 'description')} AS description, p.type, p.unit,
       CAST({_pick_col('p', 'cost_price')} AS DOUBLE) AS cost_price,
       CAST({_pick_col('p', 'min_stock')} AS DOUBLE) AS min_stock,
       CAST({_pick_col('p', 'current_stock')} AS DOUBLE) AS current_stock,
       CAST({_pick_col('p', 'supplier_id')} AS DOUBLE) AS supplier_id, p.is_active,
       CASE WHEN coalesce(a.h_description OR a.h_cost_price OR a.h_min_stock OR a.h_current_stock
                          OR a.h_supplier_id, FALSE) THEN {NOW} END AS updated_at
FROM products p LEFT JOIN a ON a.id = p.id""",
    "apply_shift_updates": f"""
WITH ch AS (SELECT u.*, string_split(coalesce(u.set_columns, ''), ',') AS s FROM shift_updates u
            WHERE u.id IN (SELECT id FROM shifts)),
     a AS (SELECT id, {_latest_col('machine')}, {_latest_col('duration')} FROM ch GROUP BY id)
SELECT s.id, s.employee_id, CAST(s.date AS TIMESTAMP) AS date, {_pick_col('s', 'machine')} AS machine,
       CAST({_pick_col('s', 'duration')} AS DOUBLE) AS duration
FROM shifts s LEFT JOIN a ON a.id = s.id""",
    "soft_delete_employees": f"""
WITH hit AS (SELECT DISTINCT d.id FROM employee_deletes d JOIN employees e ON e.id = d.id)
SELECT e.id, e.name, e.position, e.shift, CAST(e.hire_date AS TIMESTAMP) AS hire_date,
       CAST(e.salary AS DOUBLE) AS salary,
       CASE WHEN hit.id IS NOT NULL THEN FALSE ELSE e.is_active END AS is_active,
       CASE WHEN hit.id IS NOT NULL THEN {NOW} END AS updated_at
FROM employees e LEFT JOIN hit ON hit.id = e.id""",
    "soft_delete_users": f"""
WITH hit AS (SELECT DISTINCT d.id FROM user_deletes d JOIN users u ON u.id = d.id)
SELECT u.id, CAST(u.employee_id AS DOUBLE) AS employee_id, u.username, u.email, u.role, u.last_login,
       CASE WHEN hit.id IS NOT NULL THEN FALSE ELSE u.is_active END AS is_active,
       CASE WHEN hit.id IS NOT NULL THEN {NOW} END AS updated_at
FROM users u LEFT JOIN hit ON hit.id = u.id""",
    "production_status_changes": f"""
WITH ok AS (SELECT * FROM production_status_changes
            WHERE status IN ('PENDING', 'IN_PROGRESS', 'COMPLETED', 'CANCELLED')
              AND id IN (SELECT id FROM production_orders)),
     l AS (SELECT id, arg_max(status, {{'a': requested_at, 'b': request_id, 'c': status}}) AS st FROM ok GROUP BY id)
SELECT po.id, po.order_number, po.product_id, CAST(po.quantity AS DOUBLE) AS quantity,
       coalesce(l.st, po.status) AS status, po.priority,
       CAST(po.planned_start_date AS TIMESTAMP) AS planned_start_date,
       CAST(po.planned_end_date AS TIMESTAMP) AS planned_end_date,
       CASE WHEN l.st IS NOT NULL THEN {NOW} END AS updated_at
FROM production_orders po LEFT JOIN l ON l.id = po.id""",
    "lookup_shifts": """
SELECT id, employee_id, CAST(date AS TIMESTAMP) AS date, machine, CAST(duration AS DOUBLE) AS duration
FROM shifts WHERE id IN (SELECT id FROM shift_deletes)""",
})

BODIES["stream_apply_movements"] = BODIES["apply_movements"]

BODIES["kardex_hot_products"] = BODIES["kardex"].replace("inventory_movements", "hot_movements")

# the job's accepted movements, written, loaded again and run through the kardex
BODIES["stored_movements_kardex"] = MOVEMENT_FOLD + """,
 inv AS (SELECT product_id, movement_type, CASE WHEN movement_type = 'EXIT' THEN -quantity ELSE quantity END AS quantity,
                requested_at AS moved_at, request_id AS reference_id, CAST(NULL AS DOUBLE) AS line_no
         FROM d WHERE accepted)
SELECT product_id, movement_type, CAST(quantity AS DOUBLE) AS quantity, moved_at, reference_id, line_no,
       CAST(CAST(closing - quantity AS DECIMAL(18,2)) AS DOUBLE) AS opening_balance,
       CAST(CAST(closing AS DECIMAL(18,2)) AS DOUBLE) AS closing_balance
FROM (SELECT *, sum(quantity) OVER (PARTITION BY product_id ORDER BY moved_at NULLS FIRST, reference_id, quantity
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closing FROM inv) x"""
BODIES["stored_movements_stock"] = MOVEMENT_FOLD + """
SELECT p.id AS product_id, CAST(coalesce(p.current_stock, 0) AS DOUBLE) AS stock_before,
       CAST(CAST(coalesce(p.current_stock, 0) + coalesce(sum(CASE WHEN d.movement_type = 'EXIT' THEN -d.quantity
                 ELSE d.quantity END) FILTER (WHERE d.accepted), 0) AS DECIMAL(12,2)) AS DOUBLE) AS stock_after
FROM products p LEFT JOIN d ON d.product_id = p.id GROUP BY p.id, p.current_stock"""


# Audit rows for accepted product creations and accepted movements, numbered after the stored maximum.
_PRODUCT_CREATED = """
     ok1 AS (SELECT * FROM product_requests WHERE sku IS NOT NULL),
     firsts AS (SELECT sku, min({'a': requested_at, 'b': request_id}) AS f FROM ok1 GROUP BY sku),
     okp AS (SELECT ok1.* FROM ok1 JOIN firsts ON ok1.sku = firsts.sku
             WHERE {'a': ok1.requested_at, 'b': ok1.request_id} = firsts.f
               AND ok1.sku NOT IN (SELECT sku FROM products WHERE sku IS NOT NULL)),
     created AS (SELECT (SELECT coalesce(max(id), 0) FROM products)
                          + row_number() OVER (ORDER BY requested_at, request_id, user_id, sku, description, type,
                                                        unit, cost_price, min_stock, supplier_id) AS id,
                        sku, user_id, requested_at, request_id FROM okp)"""

BODIES["append_audit"] = ("\nWITH RECURSIVE" + fold_ctes(
    "SELECT * FROM movement_requests",
    "m.requested_at, m.request_id, m.movement_type, m.quantity, m.user_id, m.reference_document")
    + "," + _PRODUCT_CREATED + """,
     ev AS (SELECT user_id, 'CREATE_PRODUCT' AS action,
                   concat('{"productId":', CAST(id AS VARCHAR), ',"sku":"', sku, '"}') AS details,
                   requested_at, request_id FROM created
            UNION ALL
            SELECT user_id, CASE movement_type WHEN 'ENTRY' THEN 'INVENTORY_ENTRY' ELSE 'INVENTORY_EXIT' END,
                   concat('{"movementId":', CAST(movement_id AS VARCHAR), ',"productId":', CAST(product_id AS VARCHAR),
                          ',"quantity":', CAST(CAST(CASE WHEN movement_type = 'EXIT' THEN -quantity ELSE quantity END
                                                   AS DECIMAL(12,2)) AS VARCHAR), '}'),
                   requested_at, request_id
            FROM (SELECT *, (SELECT max(id) FROM inventory_movements)
                            + row_number() OVER (ORDER BY requested_at, request_id, product_id, movement_type,
                                CASE WHEN movement_type = 'EXIT' THEN -quantity ELSE quantity END, user_id,
                                reference_document) AS movement_id
                  FROM d WHERE accepted) m)
SELECT (SELECT coalesce(max(id), 0) FROM audits)
         + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id NULLS FIRST, action NULLS FIRST,
                                       details NULLS FIRST, user_id NULLS FIRST) AS id,
       user_id, action, details, requested_at AS timestamp
FROM ev""")


BODIES.update({
    "append_wastes_rejects": """
SELECT request_id, CASE WHEN process IS NULL OR process NOT IN ('EXTRUSION', 'BLOWING') THEN 'NOT_ALLOWED:process'
                        WHEN quantity IS NULL OR quantity <= 0 THEN 'NOT_POSITIVE:quantity'
                        ELSE 'ORDER_NOT_FOUND' END AS reason
FROM waste_requests WHERE process IS NULL OR process NOT IN ('EXTRUSION', 'BLOWING') OR quantity IS NULL OR quantity <= 0
   OR order_id NOT IN (SELECT id FROM production_orders)""",
    "append_incomes_rejects": """
SELECT request_id, CASE WHEN amount IS NULL OR amount <= 0 THEN 'NOT_POSITIVE:amount'
                        WHEN date IS NULL THEN 'REQUIRED_FIELD_MISSING:date'
                        ELSE 'REQUIRED_FIELD_MISSING:source' END AS reason
FROM income_requests WHERE NOT (coalesce(amount, 0) > 0 AND date IS NOT NULL AND coalesce(source, '') <> '')""",
    "append_expenses_rejects": """
SELECT request_id, CASE WHEN amount IS NULL OR amount <= 0 THEN 'NOT_POSITIVE:amount'
                        WHEN date IS NULL THEN 'REQUIRED_FIELD_MISSING:date'
                        ELSE 'REQUIRED_FIELD_MISSING:category' END AS reason
FROM expense_requests WHERE NOT (coalesce(amount, 0) > 0 AND date IS NOT NULL AND coalesce(category, '') <> '')""",
    "append_shifts_rejects": """
SELECT request_id, CASE WHEN duration IS NULL OR duration <= 0 THEN 'NOT_POSITIVE:duration'
                        WHEN employee_id IS NULL OR employee_id = 0 THEN 'REQUIRED_FIELD_MISSING:employee_id'
                        ELSE 'REQUIRED_FIELD_MISSING:date' END AS reason
FROM shift_requests WHERE NOT (coalesce(duration, 0) > 0 AND coalesce(employee_id, 0) <> 0 AND date IS NOT NULL)""",
    "update_users_rejects": "\nWITH RECURSIVE" + _USER_STEPS + """
SELECT request_id, reason FROM told WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'NOT_FOUND' AS reason FROM user_updates WHERE id NOT IN (SELECT id FROM users)""",
})

_NEW_USERS = ("\nWITH RECURSIVE" + _user_steps(
    """SELECT * FROM user_requests WHERE coalesce(username, '') <> '' AND coalesce(role, '') <> ''
                 AND coalesce(employee_id, 0) <> 0""", "-1000000000 - x.k") + """,
     ok AS (SELECT * FROM told WHERE reason IS NULL)""")
BODIES["append_users"] = _NEW_USERS + f"""
SELECT {_numbered('ok', 'users', 'requested_at, request_id')}, employee_id, username, email, role, TRUE AS is_active,
       requested_at, request_id
FROM ok"""
BODIES["append_users_rejects"] = _NEW_USERS + """
SELECT request_id, CASE WHEN coalesce(username, '') = '' THEN 'REQUIRED_FIELD_MISSING:username'
                        WHEN coalesce(role, '') = '' THEN 'REQUIRED_FIELD_MISSING:role'
                        WHEN coalesce(employee_id, 0) = 0 THEN 'REQUIRED_FIELD_MISSING:employee_id'
                        ELSE (SELECT any_value(told.reason) FROM told WHERE told.request_id = u.request_id) END AS reason
FROM user_requests u WHERE request_id NOT IN (SELECT request_id FROM ok)"""

BODIES["stream_apply_movements_rejects"] = BODIES["apply_movements_rejects"]

_ACTIVE_HIT = """
     upd AS (SELECT u.* FROM product_updates u WHERE u.id IN (SELECT id FROM products WHERE is_active = TRUE)),
     del AS (SELECT x.* FROM product_deletes x WHERE x.id IN (SELECT id FROM products WHERE is_active = TRUE))"""
BODIES["append_audit_changes"] = "\nWITH" + _ACTIVE_HIT.lstrip("\n") + """,
     ev AS (SELECT user_id, 'UPDATE_PRODUCT' AS action,
                   concat('{"productId":', CAST(id AS VARCHAR), ',"changes":{"set_columns":"', set_columns, '"}}') AS details,
                   requested_at, request_id
            FROM (SELECT *, request_id % 50 AS user_id FROM upd)
            UNION ALL
            SELECT request_id % 50, 'DELETE_PRODUCT', concat('{"productId":', CAST(id AS VARCHAR), '}'),
                   requested_at, request_id FROM del)
SELECT (SELECT coalesce(max(id), 0) FROM audits)
         + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id NULLS FIRST, action NULLS FIRST,
                                       details NULLS FIRST, user_id NULLS FIRST) AS id,
       user_id, action, details, requested_at AS timestamp
FROM ev"""

# the same batch through jobs on bucketed tables
BODIES["stored_status_changes"] = BODIES["sales_status_changes"]
BODIES["stored_client_updates"] = BODIES["apply_client_updates"]

BODIES["kardex_period"] = f"""
SELECT * FROM ({BODIES['kardex']}) k
WHERE moved_at >= TIMESTAMP '1997-02-10 00:00:00' AND moved_at < TIMESTAMP '1997-05-20 00:00:00'"""

# reports over the orders as the status changes leave them
_MOVED = """
WITH ok AS (SELECT * FROM sales_status_changes
            WHERE status IN ('CONFIRMED', 'IN_PROGRESS', 'COMPLETED', 'CANCELLED') AND id IN (SELECT id FROM sales_orders)),
     l AS (SELECT id, arg_max(status, {'a': requested_at, 'b': request_id, 'c': status}) AS st FROM ok GROUP BY id),
     moved AS (SELECT so.* REPLACE (coalesce(l.st, so.status) AS status) FROM sales_orders so LEFT JOIN l ON l.id = so.id)
"""
for _name, _report in (("sales_by_client", "sales_by_client_range"), ("sales_kpis", "sales_kpis"), ("top_clients", "top_clients"),
                       ("dashboard_kpis", "dashboard_kpis")):
    BODIES[f"maintained_{_name}"] = _MOVED + BODIES[_report].replace("sales_orders", "moved")
