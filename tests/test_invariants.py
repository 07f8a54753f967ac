"""Cross-operator invariants and brute-force checks of the order-dependent jobs."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millbook.functions.paging import dense_number
from millbook.operators import intake as I
from millbook.operators import ledger as K
from millbook.operators import reports as R
from millbook.sources.fixtures import AS_OF
from millbook.streaming import jobs as S
from tests.conftest import SF_SMALL
from tests.helpers import D, make_tables, ts


def test_sales_reports_agree(tables_small):
    t = tables_small
    a1 = R.sales_by_client(t).agg(F.sum("total_sales"), F.sum("total_orders")).collect()[0]
    a3 = R.sales_kpis(t, AS_OF, start="1990-01-01", end="2030-12-31").collect()[0]
    a2 = R.sales_over_time(t, AS_OF, start="1990-01-01", end="2030-12-31").agg(F.sum("total_sales")).collect()[0]
    assert a1[0] == a3.total_revenue == a2[0]
    assert a1[1] == a3.total_orders


def test_kardex_closes_at_ledger_sum(tables_small):
    t = tables_small
    rows = K.kardex(t)
    assert rows.count() == t.inventory_movements.count()
    last = rows.groupBy("product_id").agg(F.max("closing_balance").alias("mx"),
                                            F.max_by("closing_balance", F.struct("moved_at", "reference_id",
                                                                                "line_no", "quantity")).alias("c"))
    joined = last.join(K.ledger_balance(t), "product_id")
    assert joined.filter(F.col("c") != F.col("ledger_stock")).count() == 0


def _brute_fold(opening, requests):
    """Pure-Python reference of W9 over (product, order key, type, qty)."""
    stock = dict(opening)
    out = {}
    for rid, pid, kind, qty in sorted(requests, key=lambda r: (r[1], r[0])):
        if pid not in stock or qty <= 0:
            continue
        bal = stock[pid]
        if kind == "EXIT":
            ok = bal >= qty
            if ok:
                stock[pid] = bal - qty
        else:
            ok = True
            stock[pid] = bal + qty
        out[rid] = (ok, bal, stock[pid])
    return out, stock


def test_movement_fold_equals_brute_force(spark):
    rng = random.Random(7)
    opening = {p: Decimal(rng.randint(0, 40)) for p in range(1, 9)}
    # product 1 is hot: about a third of all requests
    reqs = []
    for rid in range(1, 400):
        pid = 1 if rng.random() < 0.34 else rng.randint(1, 10)
        kind = "ENTRY" if rng.random() < 0.3 else "EXIT"
        qty = Decimal(rng.randint(-1, 15))
        reqs.append((rid, pid, kind, qty))
    t = make_tables(spark, products=[{"id": p, "current_stock": D(s)} for p, s in opening.items()])
    df = spark.createDataFrame(
        [(rid, ts("2024-01-01 00:00:00"), pid, kind, D(q)) for rid, pid, kind, q in reqs],
        "request_id long, requested_at timestamp_ntz, product_id long, movement_type string, quantity decimal(12,2)")
    res = K.apply_movements(t, df.repartition(5))
    want, final = _brute_fold(opening, reqs)
    got = {r.request_id: (r.accepted, r.stock_before, r.stock_after) for r in res.decisions.collect()}
    assert got == {k: (ok, D(b), D(a)) for k, (ok, b, a) in want.items()}
    stock = {r.id: r.current_stock for r in res.stock.collect()}
    assert stock == {p: D(s) for p, s in final.items()}
    n_rej = res.rejects.count()
    assert n_rej + res.movements.count() == len(reqs)
    assert min(r.stock_after for r in res.decisions.collect()) >= 0


def test_allocate_never_oversells_and_snapshot_matches_reference_rule(tables_small):
    t = tables_small
    alloc = I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF, mode="allocate")
    opening = {r.id: r.current_stock for r in t.products.select("id", "current_stock").collect()}
    after = {r.id: r.current_stock for r in alloc.stock.collect()}
    assert all(after[p] >= 0 for p in after if opening[p] >= 0)
    n_req = t.sales_order_requests.count()
    assert alloc.sales_orders.count() + alloc.rejects.count() == n_req
    snap = I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF)
    assert snap.sales_orders.count() + snap.rejects.count() == n_req
    # four outputs reconcile: lines belong to accepted orders, one movement per line
    assert snap.order_products.count() == snap.movements.count()
    moved = snap.movements.agg(F.sum("quantity")).collect()[0][0] or 0
    delta = (snap.stock.agg(F.sum("current_stock")).collect()[0][0]
             - t.products.agg(F.sum("current_stock")).collect()[0][0])
    assert moved == delta


def test_dense_number_with_wide_rows_from_many_partitions(spark):
    """The counts and the rows must come from one range exchange (a payload column
    that only the rows need once made them use two, with different bounds)."""
    df = spark.range(0, 200000, numPartitions=40).select(
        ((F.col("id") * 7919) % 200000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = dense_number(df, ["k"], start=F.lit(1), partitions=16)
    row = out.agg(F.count(F.lit(1)), F.countDistinct("seq"), F.min("seq"), F.max("seq"),
                  F.sum((F.col("seq") != F.col("k") + 1).cast("int")), F.sum(F.length("payload"))).collect()[0]
    assert list(row) == [200000, 200000, 1, 200000, 0, 200000 * 64]


def test_dense_number_is_gapless_and_ordered(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    out = dense_number(df, ["k"], start=F.lit(101), partitions=6).collect()
    assert sorted(r.seq for r in out) == list(range(101, 5101))
    assert all(r.seq == r.k + 101 for r in out)


def test_stream_stock_equals_batch(spark):
    stream = S.stream_stock_balance(spark, SF_SMALL)
    from millbook.sources.fixtures import derive_tables
    batch = K.ledger_balance(derive_tables(spark, SF_SMALL))
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_audit_stream_drops_redelivered_events(spark):
    out = S.stream_audit_log(spark, SF_SMALL, redeliver_errors=True)
    assert out.count() == out.select("id").distinct().count()
    from millbook.sources.fixtures import derive_tables
    assert out.count() == derive_tables(spark, SF_SMALL).audits.count()


def test_snapshot_sink_versions(spark, tmp_path):
    from millbook.sinks.writers import current_snapshot, read_snapshot, write_snapshot
    root = str(tmp_path / "clients")
    write_snapshot(spark.range(3), root)
    second = write_snapshot(spark.range(5), root)
    assert current_snapshot(spark, root) == second and second.endswith("v=2")
    assert read_snapshot(spark, root).count() == 5
    # a failed attempt left an unpointed v=3 behind: it is never read and never reused
    spark.range(1).write.parquet(root + "/v=3")
    assert current_snapshot(spark, root) == second
    third = write_snapshot(spark.range(7), root)
    assert third.endswith("v=4") and read_snapshot(spark, root).count() == 7
    assert spark.read.parquet(root + "/v=1").count() == 3


def test_unreadable_pointers_raise_and_keep_history(spark, tmp_path, monkeypatch):
    from millbook.sinks import writers
    root = str(tmp_path / "clients")
    writers.write_snapshot(spark.range(3), root)
    writers.write_snapshot(spark.range(5), root)

    def broken(*_args):
        raise OSError("storage is away")
    with monkeypatch.context() as m:
        m.setattr(writers, "_children", broken)
        with pytest.raises(OSError):
            writers.write_snapshot(spark.range(9), root)
        with pytest.raises(OSError):
            writers.current_snapshot(spark, root)
    assert spark.read.parquet(root + "/v=1").count() == 3 and writers.read_snapshot(spark, root).count() == 5


def test_load_tables_reads_the_current_version_and_every_batch(spark, tmp_path):
    from millbook.sinks.writers import append_rows, write_snapshot
    from millbook.sources.tables import load_tables
    for n in (1, 2):
        write_snapshot(spark.range(n).withColumn("name", F.lit("s")), str(tmp_path / "suppliers"))
    shifts = spark.range(4).withColumn("machine", F.lit("M"))
    append_rows(shifts, str(tmp_path / "shifts"))
    append_rows(shifts, str(tmp_path / "shifts"), batch_id="x")
    t = load_tables(spark, str(tmp_path), ["suppliers", "shifts"])
    assert t.suppliers.count() == 2 and t.shifts.count() == 8


def test_sales_intake_job_writes_reconciled_outputs(spark, tables_small, tmp_path):
    from millbook.operators.jobs import run_sales_intake
    from millbook.sinks.writers import read_snapshot
    t = tables_small
    paths = run_sales_intake(t, t.sales_order_requests, t.sales_order_lines, AS_OF, str(tmp_path), batch_id="b")
    orders = spark.read.parquet(paths["sales_orders"])
    rejects = spark.read.parquet(paths["rejects"])
    assert orders.count() + rejects.count() == t.sales_order_requests.count()
    moved = spark.read.parquet(paths["inventory_movements"]).agg(F.sum("quantity")).collect()[0][0] or 0
    new_stock = read_snapshot(spark, str(tmp_path / "products")).agg(F.sum("current_stock")).collect()[0][0]
    assert new_stock - t.products.agg(F.sum("current_stock")).collect()[0][0] == moved


def test_stored_tables_round_trip(spark, tables_small, tmp_path):
    """ERP tables written as parquet and read back with load_tables give the same reports."""
    from millbook.sinks.writers import write_report
    from millbook.sources.tables import load_tables
    names = ["clients", "sales_orders", "order_products", "costings", "invoices"]
    for n in names:
        write_report(tables_small[n], str(tmp_path / n))
    stored = load_tables(spark, str(tmp_path), names)
    a = R.profit_by_client(tables_small)
    b = R.profit_by_client(stored)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c = R.client_outstanding_balance(stored)
    assert c.count() == tables_small.clients.count()


def test_kardex_on_a_hot_product_matches_a_running_sum(spark):
    rng = random.Random(11)
    rows, base = [], ts("2024-01-01 00:00:00")
    import datetime as _dt
    for i in range(600):
        pid = 1 if rng.random() < 0.34 else rng.randint(2, 6)
        q = D(rng.randint(-20, 20))
        moved = base + _dt.timedelta(minutes=rng.randint(0, 60 * 24 * 10))
        rows.append({"product_id": pid, "movement_type": "ENTRY" if q > 0 else "EXIT", "quantity": q,
                     "moved_at": moved, "reference_id": i, "line_no": 1})
    t = make_tables(spark, inventory_movements=rows)
    want = {}
    for pid in {r["product_id"] for r in rows}:
        run = D(0)
        for r in sorted((r for r in rows if r["product_id"] == pid),
                        key=lambda r: (r["moved_at"], r["reference_id"])):
            run += r["quantity"]
            want[r["reference_id"]] = run
    assert {r.reference_id: r.closing_balance for r in K.kardex(t).collect()} == want


def test_kardex_keeps_rows_without_time(spark):
    rows = [{"product_id": p, "movement_type": "ENTRY", "quantity": D(q), "moved_at": at, "reference_id": i, "line_no": 1}
            for i, (p, q, at) in enumerate([(1, 5, None), (1, 2, ts("2024-01-01 10:00:00")), (None, 3, None), (1, 1, None)])]
    got = K.kardex(make_tables(spark, inventory_movements=rows)).collect()
    assert {r.reference_id: r.closing_balance for r in got} == {0: D(5), 3: D(6), 1: D(8), 2: D(3)}


def test_movement_job_appends_and_snapshots(spark, tables_small, tmp_path):
    from millbook.operators.jobs import run_movements
    from millbook.sinks.writers import read_snapshot
    t = tables_small
    paths = run_movements(t, t.movement_requests, str(tmp_path), batch_id="b")
    moved = spark.read.parquet(paths["inventory_movements"])
    rejects = spark.read.parquet(paths["rejects"])
    assert moved.count() + rejects.count() == t.movement_requests.count()
    delta = moved.agg(F.sum("quantity")).collect()[0][0]
    new_stock = read_snapshot(spark, str(tmp_path / "products")).agg(F.sum("current_stock")).collect()[0][0]
    assert new_stock - t.products.agg(F.sum("current_stock")).collect()[0][0] == delta


def test_partial_updates_equal_one_at_a_time(spark):
    """W2 against applying each request in arrival order, on random change sets."""
    from millbook.operators import changes as W
    rng = random.Random(5)
    clients = [{"id": i, "code": f"C{i}", "name": f"N{i}", "address": f"A{i}", "credit_limit": D(i),
                "payment_terms": 30, "is_active": i % 4 != 0} for i in range(1, 13)]
    reqs = []
    for rid in range(1, 150):
        cid = 1 if rng.random() < 0.34 else rng.randint(1, 14)  # a hot client, inactive and unknown ids
        cols = rng.sample(["name", "address", "credit_limit", "payment_terms", "id"], rng.randint(0, 3))
        reqs.append((rid, ts("2024-01-01 00:00:00") + __import__("datetime").timedelta(seconds=rng.randint(0, 50)),
                     cid, ",".join(cols), f"name{rid}", None if rng.random() < 0.3 else f"addr{rid}",
                     D(rng.randint(0, 999)), rng.randint(0, 90)))
    t = make_tables(spark, clients=clients)
    df = spark.createDataFrame(reqs, "request_id long, requested_at timestamp_ntz, id long, set_columns string, "
                                     "name string, address string, credit_limit decimal(12,2), payment_terms int")
    res = W.apply_partial_updates(t, "clients", df.repartition(4), "2024-02-01")
    state = {c["id"]: dict(c) for c in clients}
    touched, rejected = set(), set()
    for rid, at, cid, cols, name, addr, cl, pt in sorted(reqs, key=lambda r: (r[1], r[0])):
        if cid not in state or not state[cid]["is_active"]:
            rejected.add(rid)
            continue
        vals = {"name": name, "address": addr, "credit_limit": cl, "payment_terms": pt}
        for c in [c for c in cols.split(",") if c in vals]:
            state[cid][c] = vals[c]
            touched.add(cid)
    got = {r.id: r for r in res.rows.collect()}
    for cid, want in state.items():
        row = got[cid]
        assert (row.name, row.address, row.credit_limit, row.payment_terms) == \
            (want["name"], want["address"], want["credit_limit"], want["payment_terms"]), cid
        assert (row.updated_at is not None) == (cid in touched), cid
    assert {r.request_id for r in res.rejects.collect()} == rejected


def test_attendance_upsert_equals_one_at_a_time(spark):
    """W6 against applying each registration in arrival order (coalesce(new, old); '' and 0 are NULL)."""
    from millbook.operators import changes as W
    import datetime as _dt
    rng = random.Random(9)
    day0 = _dt.date(2024, 1, 1)
    stored = [{"id": k, "employee_id": e, "date": day0 + _dt.timedelta(days=d), "absence_reason": "OLD",
               "overtime_hours": D(1)} for k, (e, d) in enumerate([(1, 0), (1, 1), (2, 0)], start=1)]
    reqs = []
    for rid in range(1, 120):
        e, d = (1, 0) if rng.random() < 0.34 else (rng.randint(1, 3), rng.randint(0, 2))
        reason = rng.choice([None, "", "SICK", "VACATION"])
        hours = rng.choice([None, D(0), D(2), D(3.5)])
        entry = rng.choice([None, ts("2024-01-01 08:00:00") + _dt.timedelta(minutes=rng.randint(0, 300))])
        reqs.append((rid, ts("2024-02-01 00:00:00") + _dt.timedelta(seconds=rng.randint(0, 40)), e,
                     day0 + _dt.timedelta(days=d), entry, None, reason, hours))
    t = make_tables(spark, attendances=stored)
    df = spark.createDataFrame(reqs, "request_id long, requested_at timestamp_ntz, employee_id long, date date, "
                                     "entry_time timestamp_ntz, exit_time timestamp_ntz, absence_reason string, "
                                     "overtime_hours decimal(12,2)")
    got = {(r.employee_id, r.date): r for r in W.upsert_attendance(t, df.repartition(3)).rows.collect()}
    want = {(s["employee_id"], s["date"]): {"entry_time": None, "absence_reason": s["absence_reason"],
                                            "overtime_hours": s["overtime_hours"]} for s in stored}
    for rid, at, e, d, entry, _exit, reason, hours in sorted(reqs, key=lambda r: (r[1], r[0])):
        cur = want.setdefault((e, d), {"entry_time": None, "absence_reason": None, "overtime_hours": None})
        new = {"entry_time": entry, "absence_reason": reason or None, "overtime_hours": hours or None}
        for c, v in new.items():
            if v is not None:
                cur[c] = v
    assert set(got) == set(want)
    for k, w in want.items():
        r = got[k]
        assert (r.entry_time, r.absence_reason, r.overtime_hours) == \
            (w["entry_time"], w["absence_reason"], w["overtime_hours"]), k
    assert sorted(r.id for r in got.values()) == list(range(1, len(want) + 1))


def test_batch_appends_are_idempotent(spark, tables_small, tmp_path):
    from millbook.operators.jobs import run_movements
    t = tables_small
    first = run_movements(t, t.movement_requests, str(tmp_path), batch_id="b1")
    n = spark.read.parquet(first["inventory_movements"]).count()
    # a rerun reads the products the first run published, as a real one would
    from millbook.sources.tables import load_tables
    now = t.replace(products=load_tables(spark, str(tmp_path), ["products"]).products)
    assert run_movements(now, t.movement_requests, str(tmp_path), batch_id="b1") == first
    again = spark.read.parquet(first["inventory_movements"])
    assert again.count() == n and again.select("load_id").distinct().count() == 1
    stored = load_tables(spark, str(tmp_path), ["products", "inventory_movements"])
    moved = stored.inventory_movements.groupBy("product_id").agg(F.sum("quantity").alias("m"))
    change = (t.products.select(F.col("id").alias("product_id"), F.coalesce("current_stock", F.lit(0)).alias("a"))
              .join(stored.products.select(F.col("id").alias("product_id"), F.coalesce("current_stock", F.lit(0)).alias("b")),
                    "product_id").join(moved, "product_id", "left"))
    assert change.filter(F.col("b") - F.col("a") != F.coalesce("m", F.lit(0))).count() == 0
    # an attempt that failed before it published: its appends are replaced, stock is taken once
    stored.inventory_movements.limit(5).write.mode("overwrite").parquet(str(tmp_path / "inventory_movements" / "load_id=b2"))
    ledger = load_tables(spark, str(tmp_path), ["inventory_movements"], skip_batch="b2").inventory_movements
    assert ledger.count() == n
    now = now.replace(inventory_movements=ledger)
    run_movements(now, t.movement_requests, str(tmp_path), batch_id="b2")
    after = load_tables(spark, str(tmp_path), ["products", "inventory_movements"])
    total = after.inventory_movements.agg(F.sum("quantity")).first()[0]
    assert (after.products.agg(F.sum("current_stock")).first()[0]
            - t.products.agg(F.sum("current_stock")).first()[0]) == total
    ids = after.inventory_movements.select("id")
    assert ids.distinct().count() == after.inventory_movements.count() > n
    assert K.kardex(after).count() == after.inventory_movements.count()
