"""Single rules of the change and report operators on hand-made rows."""

from pyspark.sql import functions as F

from millbook.functions.money import parse_number
from millbook.functions.naming import snake_columns
from millbook.operators import changes as W
from millbook.operators import intake as I
from millbook.operators import ledger as K
from millbook.operators import reports as R
from millbook.streaming import jobs as S
from tests.helpers import D, day, make_tables, ts

AT = ts("2024-01-01 08:00:00")
OLD = ts("2020-05-05 00:00:00")


def frame(spark, schema, *rows):
    return spark.createDataFrame([(i, AT, *r) for i, r in enumerate(rows, 1)],
                                 "request_id long, requested_at timestamp_ntz, " + schema)


def reasons(df):
    return {r.request_id: r.reason for r in df.collect()}


def test_status_change_keeps_updated_at_of_other_rows(spark):
    t = make_tables(spark, sales_orders=[{"id": 1, "status": "QUOTE", "updated_at": OLD}, {"id": 2, "status": "QUOTE"}])
    out = W.apply_status_changes(t, "sales_orders", frame(spark, "id long, status string", (2, "COMPLETED")), "2024-02-01")
    assert {r.id: r.updated_at for r in out.rows.collect()} == {1: OLD, 2: ts("2024-02-01 00:00:00")}


USER = "id long, username string, email string, role string, employee_id long, is_active boolean"


def test_user_update_has_one_updated_at_and_checks_keys(spark):
    users = [{"id": i, "username": f"u{i}", "email": f"e{i}", "employee_id": 10 * i, "updated_at": OLD} for i in (1, 2, 3)]
    t = make_tables(spark, users=users)
    out = W.update_users(t, frame(
        spark, USER, (1, "u1", "e1", "A", 10, True), (1, "u2", None, "A", None, True), (2, "new", None, "A", 30, True),
        (2, "fresh", "e9", "A", None, True), (3, "fresh", None, "A", None, True), (9, "x", None, "A", None, True)), "2024-02-01")
    assert out.rows.columns.count("updated_at") == 1
    assert reasons(out.rejects) == {2: "DUPLICATE_USERNAME", 3: "DUPLICATE_EMPLOYEE", 5: "DUPLICATE_USERNAME", 6: "NOT_FOUND"}
    got = {r.id: (r.username, r.updated_at) for r in out.rows.collect()}
    now = ts("2024-02-01 00:00:00")
    assert got == {1: ("u1", now), 2: ("fresh", now), 3: ("u3", OLD)}


def test_product_update_checks_the_sku(spark):
    t = make_tables(spark, products=[{"id": i, "sku": f"S{i}", "is_active": True} for i in (1, 2)])
    out = W.apply_partial_updates(t, "products", frame(
        spark, "id long, set_columns string, sku string, unit string", (1, "sku", "S2", None), (2, "unit", "S1", "KG"),
        (1, "sku,unit", "S9", "T")), "2024-02-01")
    assert reasons(out.rejects) == {1: "DUPLICATE_SKU"}
    assert {r.id: (r.sku, r.unit) for r in out.rows.collect()} == {1: ("S9", "T"), 2: ("S2", "KG")}


def test_batch_validity_comes_before_its_number(spark):
    t = make_tables(spark, production_orders=[{"id": 1, "order_number": "OP-1", "product_id": 5}],
                    products=[{"id": 5, "current_stock": D(0)}])
    out = I.intake_batches(t, frame(
        spark, "order_id long, batch_number string, quantity_produced decimal(12,2), production_date timestamp_ntz, "
               "quality string, user_id long", (1, "B", D(0), None, None, 7), (1, "B", D(5), None, None, 7),
        (1, "B", D(6), None, None, 7), (1, "", D(6), None, None, 7), (2, "C", D(1), None, None, 7)), "2024-02-01")
    assert [r.request_id for r in out.rows.collect()] == [2]
    assert reasons(out.rejects) == {1: "NON_POSITIVE_QUANTITY", 3: "DUPLICATE_BATCH_NUMBER",
                                    4: "REQUIRED_FIELD_MISSING:batch_number", 5: "ORDER_NOT_FOUND"}
    assert [(r.batch, r.quantity, r.moved_at, r.reference_id) for r in out.movements.collect()] == [
        ("B", D(5), ts("2024-02-01 00:00:00"), 2)]


def test_null_stock_is_no_stock(spark):
    t = make_tables(spark, clients=[{"id": 1, "is_active": True}], products=[{"id": 5}, {"id": 6, "current_stock": D(3)}])
    headers = frame(spark, "client_id long, user_id long, notes string, delivery_date date",
                    (1, 1, None, None), (1, 1, None, None), (1, 1, None, None))
    lines = spark.createDataFrame([(1, 1, 5, D(1), D(1)), (2, 1, 6, D(2), D(1)), (3, 1, 6, D(2), D(1))],
                                  "request_id long, line_no int, product_id long, quantity decimal(12,2), price decimal(12,2)")
    assert {r.request_id: r.reason for r in I.check_sales_orders(t, headers, lines).collect()} == {
        1: "INSUFFICIENT_STOCK", 2: None, 3: None}
    out = I.intake_sales_orders(t, headers, lines, "2024-02-01")  # by default no order oversells
    assert reasons(out.rejects) == {1: "INSUFFICIENT_STOCK", 3: "INSUFFICIENT_STOCK"}
    assert {r.id: r.current_stock for r in out.stock.collect()} == {5: None, 6: D(1)}
    assert set(K.ERP_SCHEMAS["inventory_movements"].names) - {"id"} == set(out.movements.columns)


def test_cost_per_unit_has_two_places(spark):
    t = make_tables(spark, production_orders=[{"id": 1, "product_id": 5, "quantity": D(3)}],
                    products=[{"id": 5, "cost_price": D(1)}, {"id": 6, "cost_price": D(5)}],
                    production_consumptions=[{"order_id": 1, "material_id": 6, "consumed_quantity": D(5)}])
    assert R.production_cost_analysis(t).first().cost_per_unit == D("8.33")


def test_undated_costings_are_never_the_latest(spark):
    t = make_tables(spark, costings=[{"product_id": 1, "total": D(9)}, {"product_id": 1, "total": D(4),
                    "calculation_date": day("2024-01-01")}, {"product_id": 2, "total": D(7)}])
    assert [(r.product_id, r.product_cost) for r in R.latest_costs(t).collect()] == [(1, D(4))]


def test_profit_repeats_lines_for_tied_costs(spark):
    d = day("2024-01-01")
    t = make_tables(spark, clients=[{"id": 1, "name": "a"}],
                    sales_orders=[{"id": i, "client_id": 1, "status": "COMPLETED", "order_date": d} for i in (1, 2, 3)],
                    order_products=[{"order_id": 1, "product_id": 7, "quantity": D(2), "price": D(10)},
                                    {"order_id": 1, "product_id": 8, "quantity": D(1), "price": D(5)},
                                    {"order_id": 2, "product_id": 7, "quantity": D(1), "price": D(10)}],
                    costings=[{"product_id": 7, "total": D(c), "calculation_date": d} for c in (3, 4)])
    r = R.profit_by_client(t).first()
    assert (r.total_orders, r.total_revenue, r.total_cost) == (2, D(65), D(21))


def test_pay_is_exact_decimal(spark):
    t = make_tables(spark, employees=[{"id": 1, "name": "a", "salary": D("1000.01"), "is_active": True}],
                    attendances=[{"employee_id": 1, "date": day("2024-01-02"), "overtime_hours": D("1.5")},
                                 {"employee_id": 1, "date": day("2024-01-03"), "absence_reason": "SICK"}])
    r = R.payroll_report(t, "2024-01-01", "2024-01-31").first()
    assert str(r.hourly_rate) == "6.2500625" and str(r.overtime_pay) == "18.750187500"
    assert str(r.absence_deduction) == "50.0005000" and str(r.total_pay) == "968.759687500"


def test_required_fields_of_inserts(spark):
    t = make_tables(spark)
    incomes = frame(spark, "amount decimal(12,2), date date, source string, invoice_id long", (D(-5), day("2024-01-01"), "s", 0),
                    (D(5), None, "s", 0), (D(5), day("2024-01-01"), "", 0), (D(5), day("2024-01-01"), "s", 0))
    out = W.append_with_defaults(t, "incomes", incomes, "2024-02-01")
    assert reasons(out.rejects) == {1: "NOT_POSITIVE:amount", 2: "REQUIRED_FIELD_MISSING:date",
                                    3: "REQUIRED_FIELD_MISSING:source"}
    assert [r.request_id for r in out.rows.collect()] == [4]


def test_movement_ids_reach_the_audit_log(spark):
    t = make_tables(spark, products=[{"id": 1, "current_stock": D(5)}],
                    inventory_movements=[{"id": 41, "product_id": 1, "quantity": D(1)}])
    moved = K.apply_movements(t, frame(spark, "product_id long, movement_type string, quantity decimal(12,2), user_id long, "
                                              "reference_document string", (1, "EXIT", D(2), 3, "d"))).movements
    event = W.append_audit(t, movements=K.numbered_movements(t, moved)).first()
    assert event.details == '{"movementId":42,"productId":1,"quantity":-2.00}' and event.action == "INVENTORY_EXIT"


def test_client_spelling(spark):
    df = spark.createDataFrame([(1, "12.5kg"), (2, "abc"), (3, None), (4, " -3e2 "), (5, "0"), (6, ".5")],
                               "requestId long, creditLimit string")
    got = snake_columns(df).select("request_id", parse_number("credit_limit", 7).alias("n")).collect()
    assert {r.request_id: float(r.n) for r in got} == {1: 12.5, 2: 7, 3: 7, 4: -300, 5: 7, 6: 0.5}


def files_stream(spark, tmp_path, name, parts, schema):
    """A file stream that delivers ``parts`` one micro-batch each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_audit_stream_keeps_late_events(spark, tmp_path):
    schema = "id long, user_id long, action string, details string, timestamp timestamp_ntz"
    parts = [[(i, 1, "a", "d", ts(at))] for i, at in enumerate(
        ["2024-05-05 10:00:00", "2024-05-09 10:00:00", "2024-05-01 10:00:00", "2024-05-09 10:00:00"])]
    parts += [[(2, 1, "a", "d", ts("2024-05-01 10:00:00")), (7, 1, "a", "d", None), (7, 1, "a", "d", None)],
              [(7, 1, "a", "d", None)]]
    S.audit_log_query(files_stream(spark, tmp_path, "in", parts, schema), str(tmp_path / "job")).awaitTermination()
    got = [r.id for r in S.read_audit_log(spark, str(tmp_path / "job")).collect()]
    assert sorted(got) == [0, 1, 2, 3, 7]


def test_movement_stream_accounts_for_every_request(spark, tmp_path):
    schema = ("request_id long, requested_at timestamp_ntz, product_id long, movement_type string, quantity decimal(12,2), "
              "user_id long, reference_document string")
    rows = [(1, AT, 1, "EXIT", D(4), 1, "a"), (2, AT, 1, "EXIT", D(4), 1, "a"), (3, AT, 1, "ENTRY", D(9), 1, "a"),
            (4, AT, 99, "EXIT", D(1), 1, "a"), (5, AT, 1, "MOVE", D(1), 1, "a"), (6, AT, 1, "EXIT", D(0), 1, "a"),
            (7, AT, 1, "EXIT", D(8), 1, "a"), (8, AT, None, "EXIT", D(8), 1, "a")]
    products = make_tables(spark, products=[{"id": 1, "current_stock": D(5)}]).products
    root = str(tmp_path / "job")
    requests = files_stream(spark, tmp_path, "in", [[r] for r in rows], schema)
    for start in (S.movement_decisions_query, S.invalid_movements_query):
        q = start(requests, products, root)
        q.awaitTermination()
        assert len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) > 1
    decided = {r.request_id: r.accepted for r in spark.read.parquet(root + "/out").collect()}
    refused = reasons(spark.read.parquet(root + "/rejects"))
    assert decided == {1: True, 2: False, 3: True, 7: True}
    assert refused == {4: "PRODUCT_NOT_FOUND", 5: "INVALID_MOVEMENT_TYPE", 6: "NON_POSITIVE_QUANTITY", 8: "PRODUCT_NOT_FOUND"}


def test_movement_stream_folds_many_products_per_call(spark, tmp_path, monkeypatch):
    """Products share a slot and its state over micro-batches; ties are told apart by the text, nulls come through."""
    monkeypatch.setattr(S, "FOLD_SLOTS", 3)
    schema = ("request_id long, requested_at timestamp_ntz, product_id long, movement_type string, quantity decimal(12,2), "
              "user_id long, reference_document string")
    first = [(p, AT, p, "EXIT", D(p % 4 + 1), None, "x") for p in range(40)]
    second = [(100 + p, None if p % 5 == 0 else AT, p, "ENTRY", D("1.25"), 2, None) for p in range(40)]
    third = [(200, AT, 7, "EXIT", D(1), None, t) for t in ("c", "a", "b")] + [(201, AT, 8, "EXIT", D(1), 3, None)]
    products = make_tables(spark, products=[{"id": p, "current_stock": D(2)} for p in range(40)]).products
    root = str(tmp_path / "job")
    q = S.movement_decisions_query(files_stream(spark, tmp_path, "in", [first, second, third], schema), products, root)
    q.awaitTermination()
    got = {(r.request_id, r.reference_document if r.request_id == 200 else r.product_id): r
           for r in spark.read.parquet(root + "/out").collect()}
    assert len(got) == 84
    stock = {}
    for rid, at, p, kind, amount, user, text in first + second + sorted(third, key=lambda r: (r[0], r[6] or "")):
        before = stock.get(p, D(2))
        ok = kind == "ENTRY" or before >= D(amount)
        stock[p] = before + (D(amount) if kind == "ENTRY" else -D(amount)) * ok
        assert tuple(got[rid, text if rid == 200 else p]) == (rid, at, p, kind, D(amount), user, text, ok, before, stock[p])


def test_movement_stream_calls_python_per_slot(spark, tmp_path):
    schema = ("request_id long, requested_at timestamp_ntz, product_id long, movement_type string, quantity decimal(12,2), "
              "user_id long, reference_document string")
    products = make_tables(spark, products=[{"id": 1, "current_stock": D(5)}]).products
    q = S.movement_decisions_query(files_stream(spark, tmp_path, "in", [[(1, AT, 1, "EXIT", D(4), 1, "a")]], schema),
                                   products, str(tmp_path / "job"))
    q.awaitTermination()
    plan = q._jsq.streamingQuery().lastExecution().executedPlan().toString()
    assert "[_slot#" in plan[plan.index("FlatMapGroupsInPandasWithState"):].split("\n")[0]


def test_jdbc_slices_are_passed_on():
    from millbook.sources import tables
    seen = {}

    class Reader:
        def jdbc(self, **options):
            seen.update(options)

    class Session:
        read = Reader()

    loaded = tables.load_tables_jdbc(Session(), "jdbc:x", {}, ["clients"], ranges={
        "clients": {"column": "id", "lowerBound": 1, "upperBound": 9, "numPartitions": 4}})
    assert loaded["clients"] is None  # what the stub returns
    assert seen["numPartitions"] == 4 and seen["column"] == "id"


def test_reject_rules_split_the_input(spark):
    df = frame(spark, "employee_id long", (0,), (None,), (3,))
    kept, rejected = W.reject_missing(df, "employee_id")
    assert [r.request_id for r in kept.collect()] == [3] and rejected.count() == 2
    assert df.count() == kept.select(F.col("request_id")).count() + rejected.count()
