"""Explicit StructTypes: the driver's parquet tables and the 19 ERP tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)      # stored money / quantity columns
WIDE_MONEY = T.DecimalType(18, 2)  # reported sums

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Driver tables (parquet `timestamp[us]` is read as timestamp_ntz).
DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", _I), ("r_name", _S)),
    "nation": _struct(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _struct(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _struct(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _struct(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _struct(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _struct(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
}

# The 19 ERP tables as the library expects them (FIXTURES.md section 1).
# Columns a store does not have may be absent; operators only touch the
# columns they name, so Catalyst prunes the rest at the scan.
ERP_SCHEMAS: dict[str, T.StructType] = {
    "clients": _struct(("id", _L), ("code", _S), ("name", _S), ("address", _S),
                       ("credit_limit", MONEY), ("payment_terms", _I), ("is_active", T.BooleanType()),
                       ("updated_at", _TS)),
    "suppliers": _struct(("id", _L), ("name", _S), ("is_active", T.BooleanType())),
    "products": _struct(("id", _L), ("sku", _S), ("description", _S), ("type", _S), ("unit", _S),
                        ("cost_price", MONEY), ("min_stock", MONEY), ("current_stock", MONEY),
                        ("supplier_id", _L), ("is_active", T.BooleanType()), ("updated_at", _TS)),
    "sales_orders": _struct(("id", _L), ("order_number", _S), ("client_id", _L),
                            ("order_date", T.DateType()), ("created_at", _TS),
                            ("delivery_date", T.DateType()), ("subtotal", MONEY),
                            ("tax_amount", MONEY), ("total", MONEY), ("notes", _S), ("status", _S),
                            ("created_by", _L), ("updated_at", _TS)),
    "order_products": _struct(("order_id", _L), ("product_id", _L), ("quantity", MONEY), ("price", MONEY)),
    "invoices": _struct(("order_id", _L), ("status", _S)),
    "inventory_movements": _struct(("id", _L), ("product_id", _L), ("movement_type", _S), ("quantity", MONEY),
                                   ("moved_at", _TS), ("reference_id", _L), ("line_no", _I), ("user_id", _L),
                                   ("reference_document", _S), ("notes", _S), ("batch", _S)),
    "production_orders": _struct(("id", _L), ("order_number", _S), ("product_id", _L),
                                 ("quantity", MONEY), ("status", _S), ("priority", _S),
                                 ("planned_start_date", T.DateType()), ("planned_end_date", T.DateType()),
                                 ("updated_at", _TS)),
    "production_consumptions": _struct(("order_id", _L), ("material_id", _L),
                                       ("consumed_quantity", MONEY), ("date", _TS)),
    "production_batches": _struct(("batch_number", _S), ("order_id", _L), ("quality", _S),
                                  ("production_date", _TS)),
    "wastes": _struct(("id", _L), ("order_id", _L), ("process", _S), ("quantity", MONEY),
                      ("reason", _S), ("date", _TS)),
    "costings": _struct(("product_id", _L), ("material_cost", MONEY), ("labor_cost", MONEY),
                        ("waste_cost", MONEY), ("total", MONEY), ("calculation_date", T.DateType())),
    "incomes": _struct(("id", _L), ("amount", MONEY), ("date", T.DateType()), ("source", _S),
                       ("invoice_id", _L)),
    "expenses": _struct(("id", _L), ("amount", MONEY), ("date", T.DateType()), ("category", _S),
                        ("supplier_id", _L)),
    "employees": _struct(("id", _L), ("name", _S), ("position", _S), ("shift", _S),
                         ("hire_date", T.DateType()), ("salary", MONEY), ("is_active", T.BooleanType()),
                         ("updated_at", _TS)),
    "users": _struct(("id", _L), ("employee_id", _L), ("username", _S), ("email", _S),
                     ("role", _S), ("is_active", T.BooleanType()), ("last_login", _TS), ("updated_at", _TS)),
    "attendances": _struct(("id", _L), ("employee_id", _L), ("date", T.DateType()),
                           ("entry_time", _TS), ("exit_time", _TS), ("absence_reason", _S),
                           ("overtime_hours", MONEY)),
    "shifts": _struct(("id", _L), ("employee_id", _L), ("date", T.DateType()), ("machine", _S),
                      ("duration", MONEY)),
    "audits": _struct(("id", _L), ("user_id", _L), ("action", _S), ("details", _S), ("timestamp", _TS)),
}

ERP_TABLES = tuple(ERP_SCHEMAS)
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)
