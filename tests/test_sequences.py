"""Set-oriented jobs against one-at-a-time application: order intake, stock decisions, unique keys, the audit stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from millbook.operators import changes as W
from millbook.operators import intake as I
from millbook.operators import ledger as K
from millbook.operators.ownership import resolve_keys
from millbook.streaming import jobs as S
from tests.conftest import SF_SMALL
from tests.helpers import D, make_tables, ts
from tests.test_plans import plan_of

AT = ts("2024-01-01 08:00:00")


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Rounds of small jobs: two partitions are enough to split keys over."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
HEADER = "request_id long, requested_at timestamp_ntz, client_id long, user_id long, notes string, delivery_date date"
LINE = "request_id long, line_no int, product_id long, quantity decimal(12,2), price decimal(12,2)"


# --- W12: order by order -------------------------------------------------------------------
def orders_frames(spark, orders):
    """``orders``: lists of (product, quantity) in arrival order; request ids run against it."""
    n = len(orders)
    heads = [(n - i, ts(f"2024-01-01 08:{i // 60:02d}:{i % 60:02d}"), 1, 7, None, None) for i in range(n)]
    lines = [(n - i, k, p, None if q is None else D(q), D(1)) for i, own in enumerate(orders) for k, (p, q) in enumerate(own)]
    return spark.createDataFrame(heads, HEADER).repartition(3), spark.createDataFrame(lines, LINE).repartition(3)


def one_by_one(stock, orders):
    """(reasons by request id, stock after) as the orders would be taken one after the other."""
    stock, n, reasons = dict(stock), len(orders), {}
    for i, own in enumerate(orders):
        reason = None if own else "EMPTY_ORDER"
        for p, q in own:
            if p not in stock:
                reason = reason or "PRODUCT_NOT_FOUND"
            elif q is not None and D(stock[p] or 0) < D(q):
                reason = reason or "INSUFFICIENT_STOCK"
        if reason:
            reasons[n - i] = reason
        else:
            for p, q in own:
                stock[p] = D(stock[p] or 0) - D(q or 0)
    return reasons, stock


def exact(spark, stock, orders):
    t = make_tables(spark, clients=[{"id": 1, "credit_limit": None}],
                    products=[{"id": p, "current_stock": None if s is None else D(s), "is_active": True} for p, s in stock.items()])
    out = I.intake_sales_orders(t, *orders_frames(spark, orders), "2024-02-01", mode="exact")
    return ({r.request_id: r.reason for r in out.rejects.collect()}, {r.id: r.current_stock for r in out.stock.collect()}, out)


def test_exact_intake_frees_what_a_rejected_order_wanted(spark):
    stock = {1: 10, 2: 1}
    orders = [[(1, 8), (2, 2)], [(1, 9)], [(1, 1), (1, 1)], [(1, 1)]]
    reasons, after, out = exact(spark, stock, orders)
    # the first order lacks product 2, so the second finds all of product 1; the third's two lines each see the last one
    assert reasons == {4: "INSUFFICIENT_STOCK", 1: "INSUFFICIENT_STOCK"}
    assert (reasons, after) == one_by_one(stock, orders) and after == {1: D(-1), 2: D(1)}
    assert [r.request_id for r in out.sales_orders.orderBy("id").collect()] == [3, 2]
    assert out.rounds >= 1 and out.order_products.count() == 3 and out.movements.count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_exact_intake_equals_one_order_after_the_other(spark, seed):
    rng = random.Random(seed)
    stock = {p: rng.choice([0, 5, 12, 30, None, 100]) for p in range(1, 9)}
    orders = [[(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 99] if seed else [1, 2]), rng.choice([1, 2, 3, 5, 0.5, 8, -1 if seed == 2 else 2]))
               for _ in range(rng.randrange(0, 5))] for _ in range(60)]
    reasons, after, out = exact(spark, stock, orders)
    want, left = one_by_one(stock, orders)
    assert reasons == want
    # a product that no accepted order names keeps its null
    assert {p: s or D(0) for p, s in after.items()} == {p: D(s or 0) for p, s in left.items()}
    assert 1 <= out.rounds <= 60


def test_a_chain_of_orders_is_decided_in_turn(spark):
    """Each order's outcome hangs on the one before, over alternating products."""
    stock = {p: 1 for p in range(10)}
    orders = [[(p, 1), (p + 1, 1)] for p in range(9)]
    reasons, after, out = exact(spark, stock, orders)
    assert (reasons, after) == one_by_one(stock, orders)
    assert len(reasons) == 4 and out.rounds <= 9


def test_exact_intake_of_nothing(spark):
    reasons, after, out = exact(spark, {1: 3}, [[]])
    assert reasons == {1: "EMPTY_ORDER"} and after == {1: D(3)} and out.rounds == 0


# --- W9: only what comes after a shortfall is folded ------------------------------------------
MOVE = "request_id long, requested_at timestamp_ntz, product_id long, movement_type string, quantity decimal(12,2)"


def movements(spark, rows):
    return spark.createDataFrame([(i, AT if i % 3 else ts("2024-01-01 09:00:00"), p, k, D(q)) for i, (p, k, q) in enumerate(rows)], MOVE)


@pytest.mark.parametrize("hot_rows", [K.HOT_ROWS, 50])
def test_only_short_products_reach_python(spark, monkeypatch, hot_rows):
    """With a low ``hot_rows`` the products are summed over range parts."""
    decide = K.decide_stock
    monkeypatch.setattr(K, "decide_stock", lambda *a: decide(*a, hot_rows=hot_rows))
    rng = random.Random(9)
    rows = [(p, "ENTRY" if rng.random() < 0.4 else "EXIT", rng.choice([1, 2, 7])) for _ in range(400) for p in (rng.randrange(1, 6),)]
    t = make_tables(spark, products=[{"id": p, "current_stock": D(s)} for p, s in ((1, 10_000), (2, 10_000), (3, 5), (4, 0), (5, 60))])
    requests = movements(spark, rows).repartition(5)
    folded, whole = [], K.fold_stock
    monkeypatch.setattr(K, "fold_stock", lambda frame, *a, **b: folded.append(frame) or whole(frame, *a, **b))
    out = K.apply_movements(t, requests)
    balance, want, first = {1: 10_000, 2: 10_000, 3: 5, 4: 0, 5: 60}, {}, {}
    for i in sorted(range(len(rows)), key=lambda i: (i % 3 == 0, i)):
        p, kind, q = rows[i]
        ok = kind == "ENTRY" or balance[p] >= q
        if not ok:
            first.setdefault(p, (i % 3 == 0, i))
        before = balance[p]
        balance[p] += (q if kind == "ENTRY" else -q) * ok
        want[i] = (ok, D(before), D(balance[p]))
    assert {r.request_id: (r.accepted, r.stock_before, r.stock_after) for r in out.decisions.collect()} == want
    python = [(r.product_id, (r.request_id % 3 == 0, r.request_id)) for part in folded for r in part.collect()]
    assert first.keys() == {p for p, _ in python} and first.keys() <= {3, 4, 5}
    assert sorted(python) == sorted((rows[i][0], (i % 3 == 0, i)) for i in want
                                    if rows[i][0] in first and (i % 3 == 0, i) >= first[rows[i][0]])


# --- W2 / W3 / W8: keys pass from row to row --------------------------------------------------
USER = "request_id long, requested_at timestamp_ntz, id long, username string, email string, role string, employee_id long, is_active boolean"


def users_one_by_one(users, requests, inserts=False):
    held = {u["id"]: [u["username"], u["email"], u["employee_id"]] for u in users}
    names = ["DUPLICATE_USERNAME", "DUPLICATE_EMAIL", "DUPLICATE_EMPLOYEE"]
    reasons = {}
    for r in requests:
        keys, own = [r[3], r[4], r[6]], ("new", r[0]) if inserts else r[2]
        if not inserts and own not in held:
            reasons[r[0]] = "NOT_FOUND"
            continue
        hit = [n for n, k, v in zip(names, range(3), keys) if v is not None and any(
            h != own and other[k] == v for h, other in held.items())]
        if hit:
            reasons[r[0]] = hit[0]
        else:
            held[own] = keys
    return reasons, {h: tuple(k) for h, k in held.items()}


def test_swap_chain_and_freed_keys(spark):
    users = [{"id": i, "username": f"u{i}", "email": f"e{i}", "employee_id": i, "is_active": True} for i in range(1, 6)]
    t = make_tables(spark, users=users)
    told = [(1, 1, "tmp", "e1", 1), (2, 2, "u1", "e2", 2), (3, 1, "u2", "e1", 1),         # a swap by way of a third name
            (4, 3, "u4", "e3", 3), (5, 4, "x4", "e4", 4), (6, 3, "u4", "e3", 3),          # taken, freed, free
            (7, 5, "u3", "e1", 5), (8, 4, "u3", "e4", 4),                                 # a rejected request claims nothing
            (9, 5, "tmp", "e5", None), (10, 1, "u2", "e1", 5)]                            # freed by null
    rows = [(i, AT, u, name, mail, "R", emp, True) for i, u, name, mail, emp in told]
    out = W.update_users(t, spark.createDataFrame(rows, USER).repartition(3), "2024-02-01")
    reasons, held = users_one_by_one(users, rows)
    assert {r.request_id: r.reason for r in out.rejects.collect()} == reasons == {4: "DUPLICATE_USERNAME", 7: "DUPLICATE_EMAIL"}
    assert {r.id: (r.username, r.email, r.employee_id) for r in out.rows.collect()} == held


@pytest.mark.parametrize("seed,inserts", [(0, False), (1, False), (1, True)])
def test_keys_equal_one_at_a_time(spark, seed, inserts):
    rng = random.Random(seed)
    users = [{"id": i, "username": f"u{i}", "email": f"e{i}" if i % 3 else None, "employee_id": i, "is_active": True} for i in range(1, 15)]
    rows = [(i, AT, rng.randrange(1, 16) if seed else rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["hot", f"u{rng.randrange(1, 15)}", f"n{rng.randrange(6)}"]),
             rng.choice([None, f"e{rng.randrange(1, 20)}", f"m{rng.randrange(400)}"]), "R", rng.choice([None, rng.randrange(1, 90)]), True)
            for i in range(60)]
    t = make_tables(spark, users=users)
    requests = spark.createDataFrame(rows, USER).repartition(4)
    if inserts:
        rows = [r for r in rows if r[6] is not None]
        out = W.append_with_defaults(t, "users", requests.drop("id"), "2024-02-01")
        reasons = {r.request_id: r.reason for r in out.rejects.collect()}
        assert {i: r for i, r in reasons.items() if not r.startswith("REQUIRED")} == users_one_by_one(users, rows, True)[0]
    else:
        out = W.update_users(t, requests, "2024-02-01")
        reasons, held = users_one_by_one(users, rows)
        assert {r.request_id: r.reason for r in out.rejects.collect()} == reasons
        assert {r.id: (r.username, r.email, r.employee_id) for r in out.rows.collect()} == held


def test_partial_updates_pass_a_sku_on(spark):
    t = make_tables(spark, products=[{"id": i, "sku": f"S{i}", "unit": "KG", "is_active": True} for i in (1, 2, 3)])
    rows = [(1, AT, 2, "sku", "S1", None), (2, AT, 1, "unit", "S9", "T"), (3, AT, 1, "sku", "S8", None), (4, AT, 2, "sku,unit", "S1", "L"),
            (5, AT, 3, "sku", None, None), (6, AT, 1, "sku", "S3", None)]
    out = W.apply_partial_updates(t, "products", spark.createDataFrame(
        rows, "request_id long, requested_at timestamp_ntz, id long, set_columns string, sku string, unit string"), "2024-02-01")
    # the second request does not set the sku, so S1 is free only after the third; the fifth frees S3
    assert {r.request_id: r.reason for r in out.rejects.collect()} == {1: "DUPLICATE_SKU"}
    assert {r.id: (r.sku, r.unit) for r in out.rows.collect()} == {1: ("S3", "T"), 2: ("S1", "L"), 3: (None, "KG")}


def test_uncontested_keys_take_no_round(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, username string")
    rows = spark.createDataFrame([(1, AT, 1, "c"), (2, AT, 1, "a"), (3, AT, 2, None), (4, AT, 2, "b")],
                                 "request_id long, requested_at timestamp_ntz, id long, username string")
    told, rounds = resolve_keys(rows, users, {"username": "TAKEN"}, W.ARRIVAL)
    assert rounds == 0 and told.filter("reason is not null").isEmpty() and told.columns == [*rows.columns, "reason"]
    hot = spark.createDataFrame([(i, AT, i, "same") for i in range(1, 60)], rows.schema)
    told, rounds = resolve_keys(hot, users.limit(0), {"username": "TAKEN"}, W.ARRIVAL)
    assert {r.request_id for r in told.filter("reason is null").collect()} == {1} and rounds <= 2


# --- T2: only the batch's days of the log are read ---------------------------------------------
def test_the_log_is_read_by_day(spark, tmp_path):
    out = f"{tmp_path}/out"
    for epoch, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-03"]):
        spark.range(3).select("id", F.lit(day).cast("date").alias("day")).write.partitionBy("day").parquet(f"{out}/epoch={epoch}")
    days = [r["day"] for r in spark.sql("select date '2024-01-02' as day").collect()]
    read = S.logged_ids(spark, out, days, 2)
    assert len(read.inputFiles()) >= 3 and {str(r["day"]) for r in read.collect()} == {"2024-01-02"}
    scan = plan_of(read)
    assert "PartitionFilters: [isnotnull(epoch" in scan or "PartitionFilters: [" in scan
    assert "2024-01-02" in scan and "day" in scan[scan.index("PartitionFilters"):]
    assert S.logged_ids(spark, out, days, 1).isEmpty() and S.logged_ids(spark, out, [], 9).isEmpty()


AUDIT = "id long, user_id long, action string, details string, timestamp timestamp_ntz"


def test_copies_over_many_batches_and_days_are_dropped(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/job"
    rows = [(i, 1, "A", None, ts(f"2024-01-{1 + i % 5:02d} 10:00:00") if i % 7 else None) for i in range(40)]
    batches = [rows[:15], rows[10:30], rows[:5] + rows[25:], rows]
    for n, own in enumerate(batches):
        spark.createDataFrame(own, AUDIT).coalesce(1).write.mode("append").parquet(source)
        q = S.audit_log_query(spark.readStream.schema(AUDIT).parquet(source), root)
        q.awaitTermination()
    got = S.read_audit_log(spark, root).collect()
    assert sorted(r["id"] for r in got) == list(range(40))


def test_the_fold_gets_amounts_and_dates_as_numbers(spark, monkeypatch):
    """No Python object per decimal or date on the way to the fold, and the same values and types on the way back."""
    day = dt.date(2024, 2, 29)
    rows = [(1, D(5), True, 500, D(3), None, "a"), (2, D(-2), False, 100, None, day, None), (3, D("0.01"), True, 1, D(9), dt.date(1960, 1, 1), "c")]
    frame = spark.createDataFrame([(1, *r, 700) for r in rows],
                                  "product_id long, n long, amount decimal(12,2), _is_exit boolean, _q_c long, other decimal(17,5), day date, text string, open long")
    whole = K._fold_batches

    def checked(batches):
        for pdf in batches:
            held = {type(v).__name__ for c in pdf.columns if c != "text" for v in pdf[c].dropna().astype(object)}
            assert not held & {"Decimal", "date"}, held
            yield from whole(iter([pdf]))

    monkeypatch.setattr(K, "_fold_batches", checked)
    got = K.fold_stock(frame, "open", ["n"])
    assert got.select(frame.columns).schema.simpleString() == frame.schema.simpleString()
    kept = sorted(got.collect(), key=lambda r: r.n)
    assert [tuple(r[c] for c in frame.columns) for r in kept] == [tuple(r) for r in sorted(frame.collect(), key=lambda r: r.n)]
    assert [(r._accepted, r._before_c, r._after_c) for r in kept] == [(True, 700, 200), (True, 200, 300), (True, 300, 299)]


def test_exact_outputs_read_the_decisions(spark):
    """No output of W12's exact mode goes back to the reservations."""
    out = E.queries()["intake_sales_orders_exact_rejects"](spark, SF_SMALL)
    plan = plan_of(out, "simple")
    assert "Join" not in plan and "Window" not in plan and plan.count("FileScan") == 1, plan
