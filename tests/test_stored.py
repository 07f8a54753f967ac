"""Bucketed table versions and the ledger by month."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.operators import changes as W
from millbook.operators import order_sums as M
from millbook.operators import periods as P
from millbook.operators import reports as R
from millbook.operators.jobs import run_keyed_changes
from millbook.operators.ledger import kardex
from millbook.sinks import writers
from tests.helpers import D, day, make_tables, ts
from tests.test_plans import plan_of

AT = ts("2024-01-01 08:00:00")


# --- versions that rewrite only what changed ------------------------------------------------
def orders(spark, n=200):
    return make_tables(spark, sales_orders=[{"id": i, "client_id": i % 7, "status": "QUOTE"} for i in range(n)])


def status_batch(spark, *rows):
    return spark.createDataFrame([(i, AT, o, s) for i, (o, s) in enumerate(rows)],
                                 "request_id long, requested_at timestamp_ntz, id long, status string")


def apply_status(t, changes):
    return W.apply_status_changes(t, "sales_orders", changes, "2024-02-01")


def files(root, version):
    return {os.path.relpath(f, root): os.path.getmtime(f) for f in glob.glob(f"{root}/v={version}/**/*.parquet", recursive=True)}


def test_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    t, root = orders(spark), str(tmp_path / "orders")
    schema = t.sales_orders.schema
    assert writers.write_buckets(t.sales_orders, root, "id", buckets=16) == list(range(16))
    before = files(root, 1)
    batch = status_batch(spark, (5, "CONFIRMED"), (5, "COMPLETED"), (9999, "CONFIRMED"), (7, "NONSENSE"))
    only = writers.touched_buckets(batch, "id", root)
    written = run_keyed_changes(spark, t, "sales_orders", batch, root, schema, apply_status, "b1")
    assert set(written) <= set(only) and len(only) <= 3
    assert files(root, 1) == before and len(files(root, 2)) <= 3  # nothing of the old version is touched
    got = {r.id: r.status for r in writers.read_buckets(spark, root, schema).collect()}
    assert got == {i: "COMPLETED" if i == 5 else "QUOTE" for i in range(200)}
    assert {r.reason for r in spark.read.parquet(f"{root}-rejects/load_id=b1").collect()} == {"NOT_FOUND", "NOT_ALLOWED:status"}
    assert run_keyed_changes(spark, t, "sales_orders", batch, root, schema, apply_status, "b1") == []
    assert not os.path.exists(f"{root}/v=3")
    some = writers.read_buckets(spark, root, schema, only=only[:1])
    assert 0 < some.count() < 200


def test_buckets_empty_out_and_failed_attempts_are_not_read(spark, tmp_path):
    t = make_tables(spark, shifts=[{"id": i, "employee_id": 1} for i in (1, 2, 3)])
    root, schema = str(tmp_path / "shifts"), t.shifts.schema
    writers.write_buckets(t.shifts, root, "id", buckets=8)
    t.shifts.write.parquet(f"{root}/v=2")  # what a failed attempt left
    gone = spark.createDataFrame([(1, AT, i) for i in (1, 2, 3)], "request_id long, requested_at timestamp_ntz, id long")
    run_keyed_changes(spark, t, "shifts", gone, root, schema, W.hard_delete_shifts, "all")
    assert writers.read_buckets(spark, root, schema).isEmpty() and os.path.exists(f"{root}/_pointers/p=3")
    back = spark.createDataFrame([(4, 1, None, None, None)], schema)
    writers.write_buckets(back, root, "id", only=writers.touched_buckets(back, "id", root), batch_id="back")
    assert [r.id for r in writers.read_buckets(spark, root, schema).collect()] == [4]
    other = spark.createDataFrame([(i, 1, None, None, None) for i in range(20)], schema)
    with pytest.raises(ValueError):
        writers.write_buckets(other, root, "id", only=[0])


def test_unique_keys_are_checked_against_the_whole_table(spark, tmp_path):
    t = make_tables(spark, clients=[{"id": i, "code": f"C{i}", "is_active": True} for i in range(40)])
    root, schema = str(tmp_path / "clients"), T.StructType([f for f in t.clients.schema.fields])
    writers.write_buckets(t.clients, root, "id", buckets=32)
    batch = spark.createDataFrame([(1, AT, 3, "code", "C17"), (2, AT, 4, "code", "new")],
                                  "request_id long, requested_at timestamp_ntz, id long, set_columns string, code string")
    run_keyed_changes(spark, t, "clients", batch, root, schema,
                      lambda own, ch: W.apply_partial_updates(own, "clients", ch, "2024-02-01", stored=t.clients), "b")
    got = {r.id: r.code for r in writers.read_buckets(spark, root, schema).collect()}
    assert got == {i: "new" if i == 4 else f"C{i}" for i in range(40)}


# --- K1 over a period --------------------------------------------------------------------------
MOVE = "id long, product_id long, movement_type string, quantity decimal(12,2), moved_at timestamp_ntz, reference_id long, line_no int"


def ledger_rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, 3, None]), "EXIT", D(rng.randrange(-9, 10)),
             None if rng.random() < 0.05 else ts(f"202{rng.randrange(3)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:00"),
             i, rng.randrange(3)) for i in range(n)]


def test_a_period_equals_the_full_kardex(spark, tmp_path):
    rows, root = ledger_rows(), str(tmp_path)
    whole = spark.createDataFrame(rows, MOVE)
    for k in range(3):  # every batch has movements of every month
        P.append_ledger(whole.filter(F.col("id") % 3 == k), root, f"b{k}")
    P.append_ledger(whole.filter("id % 3 = 1"), root, "b1")  # repeated
    full = kardex(make_tables(spark, inventory_movements=[]).replace(inventory_movements=whole))
    for start, end in (("2021-02-01", "2021-03-01"), ("2020-12-15", "2021-01-15"), ("2019-01-01", "2030-01-01"), ("2025-01-01", "2025-02-01")):
        got = P.kardex_between(spark, root, start, end)
        want = full.filter((F.col("moved_at") >= start) & (F.col("moved_at") < end))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), (start, end)


def test_months_outside_the_period_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    P.append_ledger(spark.createDataFrame(ledger_rows(), MOVE), root, "b")
    read = P.stored_ledger(spark, root, (202102, 202103))
    scan = plan_of(read)
    assert "month" in scan[scan.index("PartitionFilters"):]
    assert {r.m for r in read.select(P.month_of("moved_at").alias("m")).distinct().collect()} <= {202102, 202103}
    # a batch whose marks were not written yet is not there
    os.rename(f"{root}/marks/load_id=b", f"{root}/hidden")
    P.append_ledger(spark.createDataFrame(ledger_rows(20, 2), MOVE), root, "c")
    assert P.stored_ledger(spark, root, (0, 999999)).count() == 20


# --- reports from maintained sums ---------------------------------------------------------------
def test_reports_from_sums_equal_the_full_reports(spark, tmp_path):
    rng = random.Random(8)
    statuses = ["QUOTE", "COMPLETED", "CANCELLED", "CONFIRMED", None]
    orders = [{"id": i, "client_id": rng.randrange(1, 6), "order_date": day(f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02d}") if i % 9 else None,
               "status": rng.choice(statuses), "total": D(rng.randrange(1, 500)) if i % 11 else None} for i in range(120)]
    clients = [{"id": i, "name": f"client {i}"} for i in range(1, 6)]
    whole, root = make_tables(spark, sales_orders=orders, clients=clients), str(tmp_path / "sums")
    now = []
    for k in range(4):
        batch = orders[k * 30:(k + 1) * 30]
        M.add_orders(make_tables(spark, sales_orders=batch).sales_orders, root, f"add{k}")
        before = now + batch
        changed = rng.sample(before, 12)
        now = [{**o, "status": rng.choice(statuses[1:4])} if o in changed else o for o in before]
        M.move_orders(make_tables(spark, sales_orders=[o for o in before if o in changed]).sales_orders,
                      make_tables(spark, sales_orders=now).sales_orders, root, f"move{k}")
    whole = make_tables(spark, sales_orders=now, clients=clients)
    sums = whole.replace(sales_orders=M.order_sums(spark, root))
    assert sums.sales_orders.agg(F.sum("orders")).head()[0] == 120
    args = dict(start="2024-01-05", end="2024-03-20")
    for report in (lambda t: R.sales_by_client(t), lambda t: R.sales_by_client(t, **args), lambda t: R.sales_kpis(t, "2024-03-15", **args),
                   lambda t: R.sales_kpis(t, "2024-03-15", client_id=77, **args), lambda t: R.sales_over_time(t, "2024-03-15", "monthly"),
                   lambda t: R.top_clients(t, "2024-03-15", "yearly"), lambda t: R.dashboard_kpis(t, "2024-03-15"),
                   lambda t: R.top_clients_month(t, "2024-03-15")):
        assert report(sums).collect() == report(whole).collect()
