
from decimal import Decimal

from millbook.operators import changes as W
from millbook.operators import listings as L
from millbook.operators import reports as R
from tests.helpers import D, day, make_tables, ts


def test_payroll_null_salary_missing_attendance_and_inactive(spark):
    t = make_tables(spark, employees=[
        {"id": 1, "name": "A", "position": "P", "salary": D(1600), "is_active": True},
        {"id": 2, "name": "B", "position": "P", "salary": None, "is_active": True},
        {"id": 3, "name": "C", "position": "P", "salary": D(3200), "is_active": True},
        {"id": 4, "name": "D", "position": "P", "salary": D(999), "is_active": False},
    ], attendances=[
        {"id": 10, "employee_id": 1, "date": day("2024-01-02"), "absence_reason": None, "overtime_hours": D(2)},
        {"id": 11, "employee_id": 1, "date": day("2024-01-03"), "absence_reason": "SICK", "overtime_hours": None},
        {"id": 12, "employee_id": 1, "date": day("2024-02-03"), "absence_reason": "SICK", "overtime_hours": D(9)},
        {"id": 13, "employee_id": 2, "date": day("2024-01-03"), "absence_reason": None, "overtime_hours": D(1)},
    ])
    rows = {r.employee_id: r for r in R.payroll_report(t, "2024-01-01", "2024-01-31").collect()}
    assert set(rows) == {1, 2, 3}
    a = rows[1]
    assert a.hourly_rate == 10.0 and a.total_overtime_hours == D(2) and a.total_absence_days == 1
    assert a.overtime_pay == 40.0 and a.absence_deduction == 80.0 and a.total_pay == 1560.0
    assert rows[2].total_pay is None and rows[2].hourly_rate is None
    c = rows[3]
    assert (c.total_overtime_hours, c.total_absence_days, c.total_pay) == (D(0), 0, 3200.0)


def test_payroll_requires_both_dates(spark):
    t = make_tables(spark)
    try:
        R.payroll_report(t, "2024-01-01", None)
    except ValueError:
        return
    raise AssertionError("missing end date must raise")


def test_cost_analysis_zero_quantity_no_waste_and_missing_product(spark):
    t = make_tables(spark, products=[
        {"id": 1, "sku": "F", "cost_price": D(10)}, {"id": 2, "sku": "M", "cost_price": D(3)}],
        production_orders=[
            {"id": 100, "order_number": "OP-1", "product_id": 1, "quantity": D(0)},
            {"id": 101, "order_number": "OP-2", "product_id": 1, "quantity": D(4)},
            {"id": 102, "order_number": "OP-3", "product_id": 99, "quantity": D(4)}],
        production_consumptions=[
            {"order_id": 100, "material_id": 2, "consumed_quantity": D(5)},
            {"order_id": 101, "material_id": 2, "consumed_quantity": D(2)},
            {"order_id": 101, "material_id": 2, "consumed_quantity": D(2)},
            {"order_id": 101, "material_id": 77, "consumed_quantity": D(100)}],
        wastes=[{"id": 1, "order_id": 101, "process": "EXTRUSION", "quantity": D(1.5)},
                {"id": 2, "order_id": 101, "process": "BLOWING", "quantity": D(0.5)}])
    rows = {r.order_id: r for r in R.production_cost_analysis(t).collect()}
    assert set(rows) == {100, 101}  # the order needs its product
    assert rows[100].cost_per_unit is None and rows[100].waste_cost == D(0)
    assert rows[100].material_cost == D(15)
    r = rows[101]
    assert (r.material_cost, r.waste_cost, r.labor_cost, r.total_cost) == (D(12), D(50), D(0), D(62))
    assert r.cost_per_unit == 15.5


def test_latest_cost_ties_repeat_lines_and_one_mode(spark):
    t = make_tables(spark, clients=[{"id": 1, "name": "X"}],
                    sales_orders=[{"id": 5, "client_id": 1, "status": "COMPLETED", "order_date": day("2001-01-01")}],
                    order_products=[{"order_id": 5, "product_id": 7, "quantity": D(2), "price": D(10)}],
                    costings=[{"product_id": 7, "total": D(3), "material_cost": D(1), "calculation_date": day("2001-01-02")},
                              {"product_id": 7, "total": D(4), "material_cost": D(2), "calculation_date": day("2001-01-02")},
                              {"product_id": 7, "total": D(9), "material_cost": D(9), "calculation_date": day("2000-01-02")}])
    parity = R.profit_by_client(t).collect()[0]
    assert (parity.total_orders, parity.total_revenue, parity.total_cost) == (1, D(40), D(14))
    one = R.profit_by_client(t, ties="one").collect()[0]
    assert (one.total_revenue, one.total_cost) == (D(20), D(8))


def test_outstanding_balance_counts_an_order_per_open_invoice(spark):
    t = make_tables(spark, clients=[{"id": 1, "credit_limit": D(100)}, {"id": 2, "credit_limit": D(5)}],
                    sales_orders=[{"id": 10, "client_id": 1, "total": D(30)},
                                  {"id": 11, "client_id": 1, "total": D(7)}],
                    invoices=[{"order_id": 10, "status": "PENDING"}, {"order_id": 10, "status": "OVERDUE"},
                              {"order_id": 11, "status": "PAID"}])
    bal = {r.client_id: r.outstanding_balance for r in R.client_outstanding_balance(t).collect()}
    assert bal == {1: D(60), 2: D(0)}
    once = {r.client_id: r.outstanding_balance for r in R.client_outstanding_balance(t, True).collect()}
    assert once == {1: D(30), 2: D(0)}


def test_attendance_upsert_blank_and_zero_never_overwrite(spark):
    t = make_tables(spark, attendances=[
        {"id": 7, "employee_id": 1, "date": day("2024-01-02"), "entry_time": ts("2024-01-02 08:00:00"),
         "absence_reason": "SICK", "overtime_hours": D(3)}])
    changes = spark.createDataFrame([
        (1, ts("2024-01-03 00:00:01"), 1, day("2024-01-02"), None, ts("2024-01-02 17:00:00"), "", Decimal("0.00")),
        (2, ts("2024-01-03 00:00:02"), 1, day("2024-01-02"), None, None, "VACATION", None),
        (3, ts("2024-01-03 00:00:03"), 1, day("2024-01-02"), None, None, None, Decimal("1.50")),
        (4, ts("2024-01-03 00:00:04"), 2, day("2024-01-05"), ts("2024-01-05 09:00:00"), None, None, None),
        (5, ts("2024-01-03 00:00:05"), 2, day("2024-01-05"), None, None, "", None),
    ], "request_id long, requested_at timestamp_ntz, employee_id long, date date, entry_time timestamp_ntz, "
       "exit_time timestamp_ntz, absence_reason string, overtime_hours decimal(12,2)")
    rows = {(r.employee_id, r.date): r for r in W.upsert_attendance(t, changes).rows.collect()}
    old = rows[(1, day("2024-01-02"))]
    assert old.id == 7 and old.entry_time == ts("2024-01-02 08:00:00")
    assert old.exit_time == ts("2024-01-02 17:00:00")
    assert old.absence_reason == "VACATION" and old.overtime_hours == D(1.5)
    new = rows[(2, day("2024-01-05"))]
    assert new.id == 8 and new.absence_reason is None and new.entry_time == ts("2024-01-05 09:00:00")


def test_partial_update_null_vs_absent_inactive_and_protected_columns(spark):
    t = make_tables(spark, clients=[
        {"id": 1, "code": "C1", "name": "Old", "address": "Here", "credit_limit": D(10), "payment_terms": 30, "is_active": True},
        {"id": 2, "code": "C2", "name": "Gone", "address": "X", "is_active": False},
        {"id": 3, "code": "C3", "name": "Same", "address": "Y", "is_active": True}])
    changes = spark.createDataFrame([
        (1, ts("2024-01-01 00:00:00"), 1, "name,address", "First", None, None, None),
        (2, ts("2024-01-02 00:00:00"), 1, "name", "Second", "ignored", None, None),
        (3, ts("2024-01-03 00:00:00"), 2, "name", "Nope", None, None, None),
        (4, ts("2024-01-04 00:00:00"), 3, "", None, None, None, None),
        (5, ts("2024-01-05 00:00:00"), 1, "id,credit_limit", None, None, Decimal("99.00"), None),
    ], "request_id long, requested_at timestamp_ntz, id long, set_columns string, name string, address string, "
       "credit_limit decimal(12,2), payment_terms int")
    res = W.apply_partial_updates(t, "clients", changes, "2024-02-01")
    rows = {r.id: r for r in res.rows.collect()}
    assert rows[1].name == "Second" and rows[1].address is None and rows[1].credit_limit == D(99)
    assert rows[1].payment_terms == 30 and rows[1].updated_at is not None
    assert rows[2].name == "Gone" and rows[3].updated_at is None
    assert [(r.request_id, r.reason) for r in res.rejects.collect()] == [(3, "NOT_FOUND")]


def test_product_insert_defaults_and_duplicate_skus(spark):
    t = make_tables(spark, products=[{"id": 40, "sku": "S-1", "is_active": True}])
    req = spark.createDataFrame([
        (1, ts("2024-01-01 00:00:01"), "S-1", None, Decimal("0.00")),
        (2, ts("2024-01-01 00:00:02"), "S-2", "", None),
        (3, ts("2024-01-01 00:00:03"), "S-2", "RAW_MATERIAL", Decimal("5.00")),
        (4, ts("2024-01-01 00:00:04"), "S-3", "RAW_MATERIAL", Decimal("5.00")),
    ], "request_id long, requested_at timestamp_ntz, sku string, type string, min_stock decimal(12,2)")
    res = W.append_with_defaults(t, "products", req, "2024-01-02",
                                 checks=[lambda df: W.reject_duplicate_key(df, "sku", t.products, "DUPLICATE_SKU")])
    rows = sorted(res.rows.collect(), key=lambda r: r.id)
    assert [(r.id, r.sku, r.type, r.min_stock, r.current_stock, r.is_active) for r in rows] == [
        (41, "S-2", "FINISHED_PRODUCT", D(0), D(0), True), (42, "S-3", "RAW_MATERIAL", D(5), D(0), True)]
    assert sorted((r.request_id, r.reason) for r in res.rejects.collect()) == [(1, "DUPLICATE_SKU"), (3, "DUPLICATE_SKU")]


def test_soft_delete_product_needs_active_client_does_not(spark):
    t = make_tables(spark, products=[{"id": 1, "is_active": False}, {"id": 2, "is_active": True}],
                    clients=[{"id": 1, "is_active": False}])
    req = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), 1), (2, ts("2024-01-01 00:00:00"), 2)],
                                "request_id long, requested_at timestamp_ntz, id long")
    p = W.soft_delete(t, "products", req, "2024-01-02")
    assert [r.request_id for r in p.rejects.collect()] == [1]
    c = W.soft_delete(t, "clients", req.filter("id = 1"), "2024-01-02")
    assert c.rejects.count() == 0 and c.rows.collect()[0].updated_at is not None


def test_paging_clamps_and_reports_totals(spark):
    t = make_tables(spark, clients=[{"id": i, "code": f"C{i}", "name": f"N{i:02d}", "is_active": True}
                                    for i in range(1, 24)])
    page = L.list_clients(t, page=0, limit=10).collect()
    assert [r.id for r in page] == list(range(1, 11))
    assert {(r.total_items, r.total_pages, r.current_page) for r in page} == {(23, 3, 1)}
    last = L.list_clients(t, page="3", limit="10").collect()
    assert [r.id for r in last] == [21, 22, 23]


def test_search_wildcards_stay_live(spark):
    t = make_tables(spark, clients=[{"id": 1, "code": "AB", "name": "x", "is_active": True},
                                    {"id": 2, "code": "A_B", "name": "y", "is_active": True}])
    assert {r.id for r in L.list_clients(t, search_text="a_b").collect()} == {2}
    assert {r.id for r in L.list_clients(t, search_text="a%b").collect()} == {1, 2}


def test_attendance_roster_keeps_employees_without_rows(spark):
    t = make_tables(spark, employees=[{"id": 1, "name": "A", "is_active": True},
                                      {"id": 2, "name": "B", "is_active": True}],
                    attendances=[{"id": 5, "employee_id": 1, "date": day("2024-01-10")},
                                 {"id": 6, "employee_id": 2, "date": day("2024-03-10")}])
    rows = L.attendance_roster(t, start="2024-01-01", end="2024-01-31").collect()
    assert [(r.employee_id, r.id) for r in rows] == [(1, 5), (2, None)]


def test_user_role_comes_from_employee_position(spark):
    t = make_tables(spark, users=[{"id": 1, "employee_id": 5, "username": "a", "role": "STORED", "is_active": True},
                                  {"id": 2, "employee_id": None, "username": "b", "role": "STORED", "is_active": True},
                                  {"id": 3, "employee_id": 5, "username": "c", "role": "STORED", "is_active": False}],
                    employees=[{"id": 5, "position": "Manager"}])
    rows = {r.id: r.role for r in L.user_effective_role(t).collect()}
    assert rows == {1: "Manager", 2: None}


def test_sales_over_time_buckets(spark):
    t = make_tables(spark, sales_orders=[
        {"id": 1, "status": "COMPLETED", "order_date": day("2001-07-16"), "created_at": ts("2001-07-16 03:00:00"), "total": D(1)},
        {"id": 2, "status": "COMPLETED", "order_date": day("2001-07-20"), "created_at": ts("2001-07-20 05:30:00"), "total": D(2)},
        {"id": 3, "status": "COMPLETED", "order_date": day("2001-07-20"), "created_at": ts("2001-07-20 05:10:00"), "total": D(3)},
        {"id": 4, "status": "QUOTE", "order_date": day("2001-07-20"), "total": D(50)},
        {"id": 5, "status": "COMPLETED", "order_date": day("2001-03-02"), "total": D(4)}])
    today = [(str(r.date), r.total_sales) for r in R.sales_over_time(t, "2001-07-20", "today").collect()]
    assert today == [("2001-07-20 05:00:00", D(5))]
    weekly = [r.total_sales for r in R.sales_over_time(t, "2001-07-20", "weekly").collect()]
    assert weekly == [D(1), D(5)]  # 2001-07-16 is a Monday
    yearly = [(str(r.date), r.total_sales) for r in R.sales_over_time(t, "2001-07-20", "yearly").collect()]
    assert yearly == [("2001-03-01 00:00:00", D(4)), ("2001-07-01 00:00:00", D(6))]
    kpis = R.sales_kpis(t, "2001-07-20", "monthly").collect()[0]
    assert (kpis.total_revenue, kpis.total_orders, kpis.average_order_value) == (D(6), 3, 2.0)
    empty = R.sales_kpis(t, "2030-01-01", "today").collect()[0]
    assert (empty.total_revenue, empty.total_orders, empty.average_order_value) == (None, 0, None)


def test_time_buckets_ignore_the_session_time_zone(spark):
    from millbook.functions.dates import bucket
    df = spark.sql("SELECT timestamp_ntz'2001-04-01 02:30:00' AS t, date'2001-07-18' AS d")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select(bucket("hour", "t").alias("h"), bucket("day", "t").alias("dt"),
                        bucket("week", "d").alias("w"), bucket("month", "d").alias("m"),
                        bucket("year", "t").alias("y")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [str(v) for v in row] == ["2001-04-01 02:00:00", "2001-04-01 00:00:00", "2001-07-16 00:00:00",
                                     "2001-07-01 00:00:00", "2001-01-01 00:00:00"]


def test_order_details_flat_and_nested(spark):
    t = make_tables(spark, clients=[{"id": 1, "name": "X", "code": "C1", "address": "A"}],
                    sales_orders=[{"id": 5, "client_id": 1, "status": "QUOTE"}, {"id": 6, "client_id": 1}],
                    order_products=[{"order_id": 5, "product_id": 7, "quantity": D(2), "price": D(10)},
                                    {"order_id": 5, "product_id": 8, "quantity": D(1), "price": D(3)},
                                    {"order_id": 5, "product_id": 99, "quantity": D(1), "price": D(3)}],
                    products=[{"id": 7, "sku": "A", "unit": "KG"}, {"id": 8, "sku": "B", "unit": "KG"}])
    flat = sorted((r.id, r.sku) for r in L.sales_order_details(t).collect())
    assert flat == [(5, "A"), (5, "B"), (6, None)]
    nested = {r.id: [p.sku for p in r.products] for r in L.sales_order_details(t, nested=True).collect()}
    assert nested == {5: ["B", "A"], 6: []}  # sorted by (quantity, price, ...)
    ids = spark.createDataFrame([(6,), (77,)], "id long")
    assert [r.id for r in L.sales_order_details(t, order_ids=ids).collect()] == [6]
