"""The 19 ERP tables derived from the driver's parquet tables (FIXTURES.md).

Each derivation is SQL text in the subset Spark and DuckDB both accept, with
``{table}`` placeholders. Spark runs it through ``spark.sql(text, **frames)``
(DataFrames as parameters, no global views); the DuckDB oracle inlines the
same text as CTEs. The derivations only shape rows into the ERP schemas; all
report and change logic lives in ``millbook.operators``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millbook.sources.schemas import DRIVER_SCHEMAS
from millbook.sources.tables import Tables

# Fixed dates of the fixtures: the stand-in for CURRENT_DATE and the payroll window.
AS_OF = "2001-07-20"
PAYROLL_START = "2024-01-05"
PAYROLL_END = "2024-01-19"

FIXTURE_SQL: dict[str, str] = {
    # is_active FALSE for 1 in 10; credit limits both above and below balances
    "clients": """
SELECT c_custkey AS id, concat('CL-', CAST(c_custkey AS STRING)) AS code, c_name AS name,
       concat('NATION_', CAST(c_nationkey AS STRING)) AS address,
       CAST(CAST(greatest(c_acctbal, 0) AS DECIMAL(12,2)) * 200 AS DECIMAL(12,2)) AS credit_limit,
       CAST(30 AS INT) AS payment_terms, c_custkey % 10 <> 0 AS is_active
FROM {customer}""",
    "suppliers": """
SELECT s_suppkey AS id, s_name AS name, s_suppkey % 10 <> 0 AS is_active FROM {supplier}""",
    # NULL supplier_id, stock below / at / above min_stock, inactive rows
    "products": """
SELECT p_partkey AS id, concat('SKU-', CAST(p_partkey AS STRING)) AS sku, p_name AS description,
       CASE WHEN p_partkey % 4 = 0 THEN 'RAW_MATERIAL' ELSE 'FINISHED_PRODUCT' END AS type,
       'KG' AS unit, CAST(p_retailprice AS DECIMAL(12,2)) AS cost_price,
       CAST(p_size AS DECIMAL(12,2)) AS min_stock,
       CAST((p_partkey * 7) % 120 AS DECIMAL(12,2)) AS current_stock,
       CAST(CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_partkey % 10 END AS BIGINT) AS supplier_id,
       p_partkey % 15 <> 0 AS is_active
FROM {part}""",
    "sales_orders": """
SELECT o_orderkey AS id,
       concat('SO-', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''), '-', CAST(o_orderkey AS STRING)) AS order_number,
       o_custkey AS client_id, CAST(o_orderdate AS DATE) AS order_date,
       CAST(o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS TIMESTAMP_NTZ) AS created_at,
       CAST(o_orderdate + INTERVAL '14' DAY AS DATE) AS delivery_date,
       CAST(o_totalprice AS DECIMAL(12,2)) AS subtotal, CAST(0 AS DECIMAL(12,2)) AS tax_amount,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderpriority AS notes,
       CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'QUOTE'
            WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' WHEN o_orderkey % 3 = 1 THEN 'IN_PROGRESS'
            ELSE 'CANCELLED' END AS status
FROM {orders}""",
    # some orders have no lines; unit price is the extended price as is
    "order_products": """
SELECT l_orderkey AS order_id, l_partkey AS product_id,
       CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price
FROM {lineitem}""",
    # no invoice for 1 in 4 orders, a second pending invoice for 1 in 40
    "invoices": """
SELECT o_orderkey AS order_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'OVERDUE' ELSE 'PAID' END AS status
FROM {orders} WHERE o_orderkey % 4 <> 3
UNION ALL
SELECT o_orderkey AS order_id, 'PENDING' AS status FROM {orders} WHERE o_orderkey % 40 = 0""",
    # the signed stock ledger: returns enter, shipments leave; times of day differ, 1 in 50 has no time
    "inventory_movements": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, CASE WHEN l_returnflag = 'R' THEN 'ENTRY' ELSE 'EXIT' END AS movement_type,
       CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS DECIMAL(12,2)) AS quantity,
       CAST(CASE WHEN (l_orderkey + l_linenumber) % 50 = 0 THEN NULL
            ELSE l_shipdate + INTERVAL '1' MINUTE * CAST((l_orderkey * 7 + l_linenumber * 61) % 1440 AS INT)
            END AS TIMESTAMP_NTZ) AS moved_at,
       l_orderkey AS reference_id, l_linenumber AS line_no
FROM {lineitem}""",
    # the same ledger with one product holding a third of it, much of it at one moment
    "hot_movements": """
SELECT id, CASE WHEN line_no % 3 = 0 THEN 1 ELSE product_id END AS product_id, movement_type, quantity,
       CASE WHEN line_no = 3 THEN CAST('1997-01-01 10:00:00' AS TIMESTAMP_NTZ) ELSE moved_at END AS moved_at,
       reference_id, line_no
FROM {inventory_movements}""",
    # every order is also a production order; quantity 0 for 1 in 97, product 0 does not exist
    "production_orders": """
SELECT o_orderkey AS id, concat('OP-', CAST(o_orderkey AS STRING)) AS order_number,
       CASE WHEN o_orderkey % 200 = 0 THEN 0 ELSE o_custkey END AS product_id, CAST(o_orderkey % 97 AS DECIMAL(12,2)) AS quantity,
       CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS priority,
       CAST(o_orderdate AS DATE) AS planned_start_date, CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS planned_end_date
FROM {orders}""",
    "production_consumptions": """
SELECT l_orderkey AS order_id, l_partkey AS material_id,
       CAST(l_quantity AS DECIMAL(12,2)) AS consumed_quantity, l_shipdate AS date
FROM {lineitem} WHERE l_returnflag = 'A'""",
    "production_batches": """
SELECT DISTINCT concat('B-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS batch_number,
       l_orderkey AS order_id, 'RELEASED' AS quality
FROM {lineitem} WHERE l_returnflag = 'N'""",
    # many production orders have no waste rows
    "wastes": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id,
       CASE WHEN l_linestatus = 'F' THEN 'EXTRUSION' ELSE 'BLOWING' END AS process,
       CAST(l_quantity AS DECIMAL(12,2)) AS quantity, 'REASON' AS reason,
       CAST(l_shipdate + INTERVAL '1' HOUR * CAST(l_linenumber AS INT) AS TIMESTAMP_NTZ) AS date
FROM {lineitem} WHERE l_returnflag = 'R'""",
    # history per product with ties on calculation_date; products % 13 = 0 have no costing, some rows no date
    "costings": """
SELECT l_partkey AS product_id, CAST(l_quantity AS DECIMAL(12,2)) AS material_cost,
       CAST(l_linenumber AS DECIMAL(12,2)) AS labor_cost, CAST(l_discount AS DECIMAL(12,2)) AS waste_cost,
       CAST(CAST(l_quantity AS DECIMAL(12,2)) + CAST(l_linenumber AS DECIMAL(12,2)) + CAST(l_discount AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS total,
       CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS calculation_date
FROM {lineitem} WHERE l_partkey % 13 <> 0""",
    "incomes": """
SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CAST(o_orderdate AS DATE) AS date,
       concat('Sale ', o_orderpriority) AS source,
       CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey END AS invoice_id
FROM {orders} WHERE o_orderstatus = 'F'""",
    "expenses": """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
       CAST(l_shipdate AS DATE) AS date,
       CASE l_returnflag WHEN 'A' THEN 'Materials' WHEN 'N' THEN 'Services' ELSE 'Rent' END AS category,
       nullif(l_suppkey, 0) AS supplier_id
FROM {lineitem} WHERE l_linestatus = 'O'""",
    # NULL salary for 1 in 25, inactive for 1 in 9
    "employees": """
SELECT user_id AS id, concat('Emp-', lpad(CAST(user_id AS STRING), 6, '0')) AS name,
       concat('Position ', CAST(user_id % 5 AS STRING)) AS position, 'MORNING' AS shift,
       DATE '2020-01-01' AS hire_date,
       CASE WHEN user_id % 25 = 0 THEN NULL ELSE CAST(8000 + user_id * 16 AS DECIMAL(12,2)) END AS salary,
       user_id % 9 <> 0 AS is_active
FROM (SELECT DISTINCT user_id FROM {events}) e""",
    "users": """
SELECT id, CASE WHEN id % 5 = 0 THEN NULL
                ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * CAST(id AS INT) END AS last_login,
       CASE WHEN id % 11 = 0 THEN NULL ELSE id END AS employee_id,
       concat('user_', CAST(id AS STRING)) AS username, concat('user_', CAST(id AS STRING), '@example.com') AS email,
       'STORED_ROLE' AS role, id % 7 <> 0 AS is_active
FROM {employees}""",
    # NULL overtime and NULL absence_reason both occur; employees % 17 = 0 have no attendance
    "attendances": """
SELECT user_id * 1000 + CAST(day_no AS BIGINT) AS id, user_id AS employee_id, date, entry_time, exit_time,
       CASE WHEN errors >= 1 THEN 'SICK' END AS absence_reason,
       CAST(nullif(purchases, 0) AS DECIMAL(12,2)) AS overtime_hours
FROM (SELECT user_id, CAST(ts AS DATE) AS date, extract(day FROM ts) AS day_no,
             min(ts) AS entry_time, max(ts) AS exit_time,
             count(*) FILTER (WHERE event_type = 'error') AS errors,
             count(*) FILTER (WHERE event_type = 'purchase') AS purchases
      FROM {events} WHERE user_id % 17 <> 0 GROUP BY user_id, CAST(ts AS DATE), extract(day FROM ts)) d""",
    "shifts": """
SELECT event_id AS id, user_id AS employee_id, CAST(ts AS DATE) AS date,
       concat('M', CAST(event_id % 4 AS STRING)) AS machine, CAST(8 AS DECIMAL(12,2)) AS duration
FROM {events} WHERE event_type = 'view'""",
    "audits": """
SELECT event_id AS id, user_id, upper(event_type) AS action, props AS details, ts AS timestamp FROM {events}""",
}

# Change sets: requests in the shape the W jobs read, one per driver row.
CHANGESET_SQL: dict[str, str] = {
    # stock movement requests: returns arrive as ENTRY, shipments leave as EXIT;
    # some name an unknown product or type, or no quantity
    "movement_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CASE WHEN l_orderkey % 101 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS product_id,
       CASE WHEN l_orderkey % 103 = 0 THEN 'ADJUST' WHEN l_returnflag = 'R' THEN 'ENTRY' ELSE 'EXIT' END AS movement_type,
       CAST(CASE WHEN l_orderkey % 107 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(12,2)) AS quantity, l_suppkey AS user_id,
       concat('LI-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS reference_document
FROM {lineitem}""",
    # product creations: some SKUs repeat inside the batch, some collide with stored ones,
    # type NULL / '' / given, min_stock 0 or given
    "product_requests": """
SELECT p_partkey AS request_id,
       CAST('2001-07-20 08:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' SECOND * CAST(p_partkey % 86400 AS INT) AS requested_at,
       CAST(p_partkey % 50 AS BIGINT) AS user_id,
       CASE WHEN p_size < 5 THEN concat('SKU-', CAST(p_partkey AS STRING))
            ELSE concat('NEW-', CAST(p_partkey - p_partkey % 3 AS STRING)) END AS sku,
       p_name AS description,
       CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'RAW_MATERIAL' END AS type,
       'KG' AS unit, CAST(p_retailprice AS DECIMAL(12,2)) AS cost_price,
       CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS DECIMAL(12,2)) AS min_stock,
       CAST(nullif(p_partkey % 10, 0) AS BIGINT) AS supplier_id
FROM {part}""",
    # new production orders, priority missing for low-priority orders
    "production_order_requests": """
SELECT o_orderkey AS request_id, o_orderdate AS requested_at, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS product_id,
       CAST(o_orderkey % 50 + 1 AS DECIMAL(12,2)) AS quantity,
       CAST(o_orderdate AS DATE) AS planned_start_date, CAST(o_orderdate + INTERVAL '10' DAY AS DATE) AS planned_end_date,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
            WHEN o_orderpriority = '1-URGENT' THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM {orders}""",
    # waste registrations; unknown processes and orders that are not production orders are rejected
    "waste_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE l_orderkey + 1000000000 END AS order_id,
       CASE WHEN l_orderkey % 71 = 0 THEN 'CUTTING' WHEN l_returnflag = 'R' THEN 'EXTRUSION' ELSE 'BLOWING' END AS process,
       CAST(CASE WHEN l_orderkey % 73 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(12,2)) AS quantity,
       concat('Reason ', l_returnflag) AS reason
FROM {lineitem}""",
    # partial client updates, one per order: supplied columns vary, NULL is supplied explicitly
    # for some addresses, 'id' is never settable, inactive clients are rejected
    "client_updates": """
SELECT o_orderkey AS request_id, o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS requested_at,
       o_custkey AS id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_limit' WHEN '2-HIGH' THEN 'name,address'
            WHEN '3-MEDIUM' THEN 'address' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'payment_terms,id' END AS set_columns,
       concat('Client ', CAST(o_orderkey AS STRING)) AS name,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('Street ', CAST(o_orderkey AS STRING)) END AS address,
       CAST(o_totalprice AS DECIMAL(12,2)) AS credit_limit, CAST(o_orderkey % 90 AS INT) AS payment_terms
FROM {orders}""",
    # whole-row user updates from signup events; employee link dropped for odd users,
    # some names belong to the next user
    "user_updates": """
SELECT event_id AS request_id, ts AS requested_at, user_id AS id,
       CASE WHEN event_id % 13 = 0 THEN concat('user_', CAST(user_id + 1 AS STRING))
            ELSE concat('u', CAST(user_id AS STRING), '_', CAST(event_id AS STRING)) END AS username,
       concat('u', CAST(event_id AS STRING), '@example.org') AS email,
       CASE WHEN value > 50 THEN 'ADMIN' ELSE NULL END AS role,
       CASE WHEN user_id % 2 = 0 THEN user_id END AS employee_id,
       value > 10 AS is_active
FROM {events} WHERE event_type = 'signup'""",
    # deletions: product ids named by returned line items (repeats, inactive and unknown ids occur)
    "product_deletes": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000 ELSE l_partkey END AS id
FROM {lineitem} WHERE l_returnflag = 'R'""",
    "client_deletes": """
SELECT o_orderkey AS request_id, o_orderdate AS requested_at, o_custkey AS id
FROM {orders} WHERE o_orderpriority = '5-LOW'""",
    # shift deletions by event id: low-value view events are shifts, click events are not
    "shift_deletes": """
SELECT event_id AS request_id, ts AS requested_at, event_id AS id
FROM {events} WHERE (event_type = 'view' AND value < 25) OR event_type = 'click'""",
    # attendance registrations, one per event; '' and 0 inputs must not overwrite
    "attendance_changes": """
SELECT event_id AS request_id, ts AS requested_at, user_id AS employee_id, CAST(ts AS DATE) AS date,
       CASE WHEN event_type = 'view' THEN ts END AS entry_time,
       CASE WHEN event_type = 'click' THEN ts END AS exit_time,
       CASE event_type WHEN 'error' THEN 'SICK' WHEN 'signup' THEN '' END AS absence_reason,
       CAST(CASE event_type WHEN 'purchase' THEN value WHEN 'signup' THEN 0 END AS DECIMAL(12,2)) AS overtime_hours
FROM {events}""",
    # status changes, one per line item (QUOTE is not an allowed target)
    "sales_status_changes": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at, l_orderkey AS id,
       CASE l_returnflag WHEN 'R' THEN 'CANCELLED' WHEN 'A' THEN 'COMPLETED'
            ELSE CASE WHEN l_linestatus = 'O' THEN 'QUOTE' ELSE 'CONFIRMED' END END AS status
FROM {lineitem}""",
    # costing registrations: parts missing or 0, date missing for open lines
    "costing_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CASE WHEN l_linenumber = 6 THEN l_partkey + 1000000 ELSE l_partkey END AS product_id,
       CAST(l_quantity AS DECIMAL(12,2)) AS material_cost,
       CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS DECIMAL(12,2)) AS labor_cost,
       CAST(l_discount * 100 AS DECIMAL(12,2)) AS waste_cost,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS calculation_date
FROM {lineitem}""",
    # sales-order requests: one per order, 1 in 50 names an unknown client
    "sales_order_requests": """
SELECT o_orderkey AS request_id,
       o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS requested_at,
       CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS client_id,
       o_orderkey % 100 AS user_id, o_orderpriority AS notes,
       CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS delivery_date
FROM {orders}""",
    # their lines (some requests have none; request prices differ from the catalogue)
    "sales_order_lines": """
SELECT l_orderkey AS request_id, l_linenumber AS line_no, l_partkey AS product_id,
       CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
       CAST(l_discount * 1000 + l_linenumber AS DECIMAL(12,2)) AS price
FROM {lineitem}""",
    # material consumptions; line 7 names an order that does not exist
    "consumption_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS order_id,
       l_partkey AS material_id, CAST(l_quantity AS DECIMAL(12,2)) AS consumed_quantity, l_suppkey AS user_id
FROM {lineitem}""",
    # finished batches: numbers repeat inside the batch, some are already stored or empty, some quantities are 0
    "batch_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at, l_orderkey AS order_id,
       CASE WHEN l_linenumber = 1 THEN concat('B-', CAST(l_orderkey AS STRING), '-1')
            WHEN l_linenumber = 6 THEN ''
            ELSE concat('NB-', CAST(l_orderkey - l_orderkey % 8 AS STRING)) END AS batch_number,
       CAST(CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(12,2)) AS quantity_produced,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate END AS production_date,
       CASE WHEN l_discount > 0.05 THEN 'QUARANTINE' WHEN l_discount > 0.02 THEN '' END AS quality,
       l_suppkey AS user_id
FROM {lineitem} WHERE l_returnflag <> 'R'""",
    # client creations: codes repeat inside the batch or collide with stored ones;
    # credit limit 0 / NULL and payment terms 0 / NULL take the defaults
    "client_requests": """
SELECT c_custkey AS request_id,
       CAST('2001-07-20 09:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' SECOND * CAST(c_custkey % 86400 AS INT) AS requested_at,
       CASE WHEN c_nationkey < 3 THEN concat('CL-', CAST(c_custkey AS STRING))
            ELSE concat('NC-', CAST(c_custkey - c_custkey % 2 AS STRING)) END AS code,
       c_name AS name, concat('Addr ', CAST(c_nationkey AS STRING)) AS address,
       CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS DECIMAL(12,2)) AS credit_limit,
       CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'MACHINERY' THEN NULL ELSE 60 END AS INT) AS payment_terms
FROM {customer}""",
    # employee creations: shift '' / NULL default to MORNING, salary 0 becomes NULL
    "employee_requests": """
SELECT event_id AS request_id, ts AS requested_at, concat('New ', CAST(event_id AS STRING)) AS name,
       concat('Position ', CAST(user_id % 5 AS STRING)) AS position,
       CASE WHEN value > 70 THEN 'NIGHT' WHEN value > 30 THEN '' END AS shift,
       CAST(ts AS DATE) AS hire_date,
       CAST(CASE WHEN value > 50 THEN value * 100 ELSE 0 END AS DECIMAL(12,2)) AS salary
FROM {events} WHERE event_type = 'signup'""",
    # income registrations: invoice 0 means none; some lack an amount, a date or a source
    "income_requests": """
SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
       CAST(CASE WHEN o_orderkey % 61 = 0 THEN -5 ELSE o_totalprice END AS DECIMAL(12,2)) AS amount,
       CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       CASE o_orderkey % 59 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('Order ', o_orderpriority) END AS source,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS invoice_id
FROM {orders} WHERE o_orderstatus = 'O'""",
    # expense registrations: supplier 0 means none; some lack an amount, a date or a category
    "expense_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at,
       CAST(CASE WHEN l_orderkey % 61 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(12,2)) AS amount,
       CASE WHEN l_orderkey % 67 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
       CASE WHEN l_orderkey % 59 = 0 THEN '' WHEN l_linestatus = 'O' THEN 'Energy' ELSE 'Freight' END AS category,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE l_suppkey END AS supplier_id
FROM {lineitem} WHERE l_returnflag = 'N'""",
    # shift creations from click events; some have no employee or no duration
    "shift_requests": """
SELECT event_id AS request_id, ts AS requested_at,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS employee_id, CAST(ts AS DATE) AS date,
       concat('M', CAST(user_id % 6 AS STRING)) AS machine,
       CAST(CASE WHEN event_id % 37 = 0 THEN 0 ELSE 4 + user_id % 5 END AS DECIMAL(12,2)) AS duration
FROM {events} WHERE event_type = 'click'""",
    # user creations from purchase events: names repeat, some are stored, some lack a role or an employee
    "user_requests": """
SELECT event_id AS request_id, ts AS requested_at,
       CASE WHEN event_id % 9 = 0 THEN concat('user_', CAST(user_id AS STRING))
            ELSE concat('new_', CAST(event_id - event_id % 4 AS STRING)) END AS username,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('n', CAST(event_id AS STRING), '@example.org') END AS email,
       CASE WHEN value < 5 THEN '' WHEN value < 60 THEN 'OPERATOR' ELSE 'ADMIN' END AS role,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id + 1000000000 END AS employee_id
FROM {events} WHERE event_type = 'purchase'""",
    # partial product updates: stock set directly, several columns, explicit NULL supplier
    "product_updates": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at, l_partkey AS id,
       CASE l_linenumber WHEN 1 THEN 'current_stock' WHEN 2 THEN 'description,cost_price'
            WHEN 3 THEN 'min_stock,updated_at' ELSE 'supplier_id' END AS set_columns,
       CAST(l_quantity AS DECIMAL(12,2)) AS current_stock, concat('Desc ', CAST(l_orderkey AS STRING)) AS description,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS cost_price, CAST(l_quantity AS DECIMAL(12,2)) AS min_stock,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE l_suppkey END AS supplier_id
FROM {lineitem} WHERE l_returnflag = 'A'""",
    # partial shift updates aimed at the event before each purchase (a shift only if it was a view)
    "shift_updates": """
SELECT event_id AS request_id, ts AS requested_at, event_id - 1 AS id,
       CASE WHEN value > 50 THEN 'machine' ELSE 'duration,machine' END AS set_columns,
       concat('R', CAST(event_id % 3 AS STRING)) AS machine, CAST(value AS DECIMAL(12,2)) AS duration
FROM {events} WHERE event_type = 'purchase'""",
    "employee_deletes": """
SELECT event_id AS request_id, ts AS requested_at, user_id AS id FROM {events} WHERE event_type = 'error'""",
    "user_deletes": """
SELECT event_id AS request_id, ts AS requested_at, user_id AS id FROM {events} WHERE event_type = 'signup'""",
    # production status changes; DONE is not an allowed status
    "production_status_changes": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_shipdate AS requested_at, l_orderkey AS id,
       CASE WHEN l_linestatus = 'O' THEN 'IN_PROGRESS'
            ELSE CASE l_returnflag WHEN 'R' THEN 'CANCELLED' WHEN 'A' THEN 'COMPLETED' ELSE 'DONE' END END AS status
FROM {lineitem}""",
}
FIXTURE_SQL.update(CHANGESET_SQL)

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fixture_dependencies(name: str) -> list[str]:
    """Tables (driver or fixture) a fixture reads, in order of first use."""
    seen: list[str] = []
    for dep in _PLACEHOLDER.findall(FIXTURE_SQL[name]):
        if dep not in seen:
            seen.append(dep)
    return seen


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Driver tables plus the 19 ERP tables derived from them, lazily planned."""
    entries: dict = {}
    bundle = Tables(entries)  # factories below resolve dependencies through it

    def driver(name: str):
        return lambda: read_driver_table(spark, sf_dir, name)

    def fixture(name: str):
        def build() -> DataFrame:
            deps = {d: bundle[d] for d in fixture_dependencies(name)}
            return spark.sql(FIXTURE_SQL[name], **deps)
        return build

    for name in DRIVER_SCHEMAS:
        entries[name] = driver(name)
    for name in FIXTURE_SQL:
        entries[name] = fixture(name)
    bundle._entries = entries
    return bundle


def duckdb_ctes(body_sql: str) -> str:
    """``WITH`` clause defining every fixture ``body_sql`` refers to (transitively).

    Driver tables are views in the oracle's DuckDB connection, so only the
    fixture tables become CTEs, in dependency order.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in FIXTURE_SQL:
            return
        for dep in fixture_dependencies(name):
            visit(dep)
        order.append(name)

    for name in FIXTURE_SQL:
        if re.search(rf"\b{name}\b", body_sql):
            visit(name)
    if not order:
        return ""
    parts = [f"{n} AS ({to_duckdb(_PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[n])).strip()})"
             for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def to_duckdb(sql: str) -> str:
    """The one spelling difference of the shared subset: Spark's TIMESTAMP_NTZ."""
    return re.sub(r"\bTIMESTAMP_NTZ\b", "TIMESTAMP", sql)
