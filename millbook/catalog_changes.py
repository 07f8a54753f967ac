"""Registered ledger, change-application and intake queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.catalog import FULL_END, FULL_START, RANGE_END, RANGE_START, register
from millbook.operators import ledger as K
from millbook.operators import reports as R
from millbook.operators.jobs import run_keyed_changes, run_movements
from millbook.plans.lineage import shared_dir
from millbook.sinks.writers import read_buckets, write_buckets
from millbook.sources.fixtures import derive_tables
from millbook.sources.schemas import MONEY
from millbook.sources.tables import load_tables


@register("kardex")
def _k1(t):
    """K1: every ledger movement with opening and closing balance (from 0)."""
    return K.kardex(t)


@register("ledger_balance")
def _k1b(t):
    return K.ledger_balance(t)


@register("apply_movements")
def _w9(t):
    """Decisions of the arrival-order fold over all movement requests."""
    return K.apply_movements(t, t.movement_requests).decisions


@register("apply_movements_stock", nullable_ints=("supplier_id",))
def _w9s(t):
    """Product stock after applying every accepted movement."""
    return K.apply_movements(t, t.movement_requests).stock


@register("apply_movements_rejects")
def _w9r(t):
    return K.apply_movements(t, t.movement_requests).rejects


# ---- W1 / W8 ---------------------------------------------------------------------
from millbook.catalog import AS_OF_DEFAULT  # noqa: E402
from millbook.operators import changes as W  # noqa: E402


@register("append_products", nullable_ints=("supplier_id",))
def _w1p(t):
    """W1 + W8: product creations with defaults, SKU uniqueness, new ids."""
    return W.append_with_defaults(t, "products", t.product_requests, AS_OF_DEFAULT,
                                  checks=[lambda df: W.reject_missing(df, "sku")]).rows


@register("append_products_rejects")
def _w1pr(t):
    return W.append_with_defaults(t, "products", t.product_requests, AS_OF_DEFAULT,
                                  checks=[lambda df: W.reject_missing(df, "sku")]).rejects


@register("append_production_orders")
def _w1o(t):
    """Production orders as PENDING with default priority and OP numbers."""
    return W.append_with_defaults(
        t, "production_orders", t.production_order_requests, AS_OF_DEFAULT,
        checks=[lambda df: W.reject_not_positive(df, "quantity"),
                lambda df: W.reject_missing_reference(df, "product_id", t.products, "PRODUCT_NOT_FOUND")]).rows


@register("append_wastes")
def _w1w(t):
    """W1 + W8: waste rows stamped now; process and quantity checked, the production order must exist."""
    return W.append_with_defaults(t, "wastes", t.waste_requests, AS_OF_DEFAULT).rows


# ---- W2 / W3 ---------------------------------------------------------------------
@register("apply_client_updates")
def _w2c(t):
    """New clients snapshot after partial updates (latest supplied value per column)."""
    return W.apply_partial_updates(t, "clients", t.client_updates, AS_OF_DEFAULT).rows


@register("apply_client_updates_rejects")
def _w2cr(t):
    return W.apply_partial_updates(t, "clients", t.client_updates, AS_OF_DEFAULT).rejects


@register("update_users", nullable_ints=("employee_id",))
def _w3(t):
    """Users snapshot after whole-row updates (latest request per user)."""
    return W.update_users(t, t.user_updates, AS_OF_DEFAULT).rows


# ---- W4 / W5 ---------------------------------------------------------------------
@register("soft_delete_products", nullable_ints=("supplier_id",))
def _w4p(t):
    return W.soft_delete(t, "products", t.product_deletes, AS_OF_DEFAULT).rows


@register("soft_delete_products_rejects")
def _w4pr(t):
    return W.soft_delete(t, "products", t.product_deletes, AS_OF_DEFAULT).rejects


@register("soft_delete_clients")
def _w4c(t):
    return W.soft_delete(t, "clients", t.client_deletes, AS_OF_DEFAULT).rows


@register("hard_delete_shifts")
def _w5(t):
    return W.hard_delete_shifts(t, t.shift_deletes).rows


@register("hard_delete_shifts_rejects")
def _w5r(t):
    return W.hard_delete_shifts(t, t.shift_deletes).rejects


# ---- W6 / W7 / W15 ---------------------------------------------------------------
@register("upsert_attendance")
def _w6(t):
    """Attendances after the upsert of every change (coalesce per column)."""
    return W.upsert_attendance(t, t.attendance_changes).rows


@register("sales_status_changes")
def _w7(t):
    return W.apply_status_changes(t, "sales_orders", t.sales_status_changes, AS_OF_DEFAULT).rows


@register("sales_status_changes_rejects")
def _w7r(t):
    return W.apply_status_changes(t, "sales_orders", t.sales_status_changes, AS_OF_DEFAULT).rejects


@register("intake_costings")
def _w15(t):
    return W.intake_costings(t, t.costing_requests, AS_OF_DEFAULT).rows


@register("intake_costings_rejects")
def _w15r(t):
    return W.intake_costings(t, t.costing_requests, AS_OF_DEFAULT).rejects


# ---- W10-W14, W16 -----------------------------------------------------------------
from millbook.operators import intake as I  # noqa: E402


@register("price_sales_orders")
def _w10(t):
    """Subtotal, 16 % tax and total of every sales-order request."""
    return I.price_sales_orders(t.sales_order_lines).select("request_id", "subtotal", "tax_amount", "total")


@register("check_sales_orders")
def _w11(t):
    """First failing check (client, credit, product, stock) per request."""
    return I.check_sales_orders(t, t.sales_order_requests, t.sales_order_lines)


@register("intake_sales_orders")
def _w12(t):
    """W12 snapshot mode: the new QUOTE order headers."""
    return I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF_DEFAULT, mode="snapshot").sales_orders


@register("intake_sales_orders_lines")
def _w12l(t):
    return I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF_DEFAULT,
                                 mode="snapshot").order_products


@register("intake_sales_orders_stock", nullable_ints=("supplier_id",))
def _w12s(t):
    return I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF_DEFAULT, mode="snapshot").stock


@register("intake_sales_orders_allocate")
def _w12a(t):
    """W12 allocate mode: decisions after claiming stock per product in arrival order."""
    return I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF_DEFAULT,
                                 mode="allocate").sales_orders


def _exact(t):
    return I.intake_sales_orders(t, t.sales_order_requests, t.sales_order_lines, AS_OF_DEFAULT, mode="exact")


@register("intake_sales_orders_exact")
def _w12e(t):
    """W12 exact mode: the orders that one decision after the other accepts."""
    return _exact(t).sales_orders


@register("intake_sales_orders_exact_rejects")
def _w12er(t):
    """W12 exact mode: the others, each with the first check it fails at its turn."""
    return _exact(t).rejects


@register("intake_sales_orders_exact_stock", nullable_ints=("supplier_id",))
def _w12es(t):
    """W12 exact mode: products after all accepted orders."""
    return _exact(t).stock


@register("intake_consumptions")
def _w13(t):
    """Accepted consumptions (EXIT through the W9 fold)."""
    return I.intake_consumptions(t, t.consumption_requests, AS_OF_DEFAULT).rows


@register("intake_consumptions_rejects")
def _w13r(t):
    return I.intake_consumptions(t, t.consumption_requests, AS_OF_DEFAULT).rejects


@register("intake_batches")
def _w14(t):
    """Accepted finished batches."""
    return I.intake_batches(t, t.batch_requests, AS_OF_DEFAULT).rows


@register("intake_batches_movements", nullable_ints=("line_no",))
def _w14m(t):
    return I.intake_batches(t, t.batch_requests, AS_OF_DEFAULT).movements


@register("append_audit")
def _w16(t):
    """Audit rows for accepted product creations and stock movements."""
    created = W.append_with_defaults(t, "products", t.product_requests, AS_OF_DEFAULT,
                                     checks=[lambda df: W.reject_missing(df, "sku")]).rows
    created = created.join(t.product_requests.select("request_id", "user_id"), "request_id")
    moved = K.numbered_movements(t, K.apply_movements(t, t.movement_requests).movements)
    return W.append_audit(t, created=created, movements=moved)


@register("append_audit_changes")
def _w16c(t):
    """Audit rows for accepted product updates and deletions (the user is derived from the request)."""
    active = t.products.filter("is_active").select("id")

    def accepted(requests):
        return requests.join(active, "id", "left_semi").withColumn("user_id", F.col("request_id") % 50)

    updated = accepted(t.product_updates).withColumn("changes", F.struct("set_columns"))
    return W.append_audit(t, updated=updated, deleted=accepted(t.product_deletes))


# ---- T1 / T2 / T3 -----------------------------------------------------------------
from millbook.catalog import register_session  # noqa: E402
from millbook.streaming import jobs as S  # noqa: E402


@register_session("stream_stock_balance")
def _t1(spark, sf_dir):
    """Running stock per product from the streamed ledger (availableNow)."""
    return S.stream_stock_balance(spark, sf_dir)


@register_session("stream_audit_log")
def _t2(spark, sf_dir):
    """Audit log from the event stream, re-delivered error events dropped."""
    return S.stream_audit_log(spark, sf_dir)


@register_session("stream_apply_movements")
def _t3(spark, sf_dir):
    """W9 decisions from a stream of movement requests (stateful fold per product)."""
    return S.stream_apply_movements(spark, sf_dir)


@register_session("stream_apply_movements_rejects")
def _t3r(spark, sf_dir):
    """What the stream rejects, invalid requests and those without stock."""
    return S.stream_movement_rejects(spark, sf_dir)


# ---- more tables through W1 / W2 / W4 / W7 / Q18 -------------------------------------
@register("append_clients")
def _w1c(t):
    """W1 + W8: client creations with credit/terms defaults and unique codes."""
    return W.append_with_defaults(t, "clients", t.client_requests, AS_OF_DEFAULT).rows


@register("append_employees")
def _w1e(t):
    """Employee creations (shift default MORNING, salary 0 stored as NULL)."""
    return W.append_with_defaults(t, "employees", t.employee_requests, AS_OF_DEFAULT).rows


@register("append_incomes", nullable_ints=("invoice_id",))
def _w1i(t):
    return W.append_with_defaults(t, "incomes", t.income_requests, AS_OF_DEFAULT).rows


@register("append_expenses", nullable_ints=("supplier_id",))
def _w1x(t):
    return W.append_with_defaults(t, "expenses", t.expense_requests, AS_OF_DEFAULT).rows


@register("append_shifts")
def _w1s(t):
    return W.append_with_defaults(t, "shifts", t.shift_requests, AS_OF_DEFAULT).rows


@register("apply_product_updates", nullable_ints=("supplier_id",))
def _w2p(t):
    """Products after partial updates (current_stock may be set directly)."""
    return W.apply_partial_updates(t, "products", t.product_updates, AS_OF_DEFAULT).rows


@register("apply_shift_updates")
def _w2s(t):
    """Shifts after partial updates (any row, no updated_at)."""
    return W.apply_partial_updates(t, "shifts", t.shift_updates, AS_OF_DEFAULT).rows


@register("soft_delete_employees")
def _w4e(t):
    return W.soft_delete(t, "employees", t.employee_deletes, AS_OF_DEFAULT).rows


@register("soft_delete_users", nullable_ints=("employee_id",))
def _w4u(t):
    return W.soft_delete(t, "users", t.user_deletes, AS_OF_DEFAULT).rows


@register("production_status_changes")
def _w7p(t):
    return W.apply_status_changes(t, "production_orders", t.production_status_changes, AS_OF_DEFAULT).rows


@register("lookup_shifts")
def _q18s(t):
    """Q18: shifts named by deletion requests, in any state."""
    from millbook.operators import listings as L
    return L.lookup_active(t, "shifts", t.shift_deletes.select("id"))


@register("kardex_hot_products")
def _k1h(t):
    """K1 over a ledger in which one product holds a third of the rows, most of them at one moment."""
    return K.kardex(t.replace(inventory_movements=t.hot_movements))


# ---- rejects and user creation -----------------------------------------------------------
@register("append_users")
def _w1u(t):
    """W1 + W8: user creations (no password part): required fields, unique username, email and employee."""
    return W.append_with_defaults(t, "users", t.user_requests, AS_OF_DEFAULT).rows.drop("last_login", "updated_at")


@register("update_users_rejects")
def _w3r(t):
    return W.update_users(t, t.user_updates, AS_OF_DEFAULT).rejects


@register("intake_batches_rejects")
def _w14r(t):
    return I.intake_batches(t, t.batch_requests, AS_OF_DEFAULT).rejects


for _table, _requests in (("users", "user_requests"), ("incomes", "income_requests"), ("expenses", "expense_requests"),
                          ("shifts", "shift_requests"), ("wastes", "waste_requests")):
    register(f"append_{_table}_rejects")(
        lambda t, table=_table, requests=_requests:
        W.append_with_defaults(t, table, t[requests], AS_OF_DEFAULT).rejects)


# ---- jobs: write, load again, go on ------------------------------------------------------
def _stored(spark, sf_dir):
    """The movement job's folder, its batch run twice (the second run changes nothing)."""
    t = derive_tables(spark, sf_dir)
    root = f"{shared_dir(spark)}/movement-job-{uuid.uuid4().hex}"
    run_movements(t, t.movement_requests, root, batch_id="first")
    run_movements(t.replace(products=load_tables(spark, root, ["products"]).products), t.movement_requests, root,
                  batch_id="first")
    return t, load_tables(spark, root, ["products", "inventory_movements"])


@register_session("stored_movements_kardex", nullable_ints=("line_no",))
def _job_kardex(spark, sf_dir):
    """W9 as a job, its written ledger loaded again and run through K1."""
    return K.kardex(_stored(spark, sf_dir)[1])


@register_session("stored_movements_stock")
def _job_stock(spark, sf_dir):
    """Stock before the job and in the snapshot it published."""
    t, stored = _stored(spark, sf_dir)
    after = stored.products.select(F.col("id").alias("product_id"), F.coalesce("current_stock", F.lit(0)).alias("stock_after"))
    before = t.products.select(F.col("id").alias("product_id"), F.coalesce("current_stock", F.lit(0)).alias("stock_before"))
    return before.join(after, "product_id").select(
        "product_id", *[F.col(c).cast(MONEY).alias(c) for c in ("stock_before", "stock_after")])


def _bucketed(t, table, changes, apply):
    """A table written in buckets, changed by two jobs of half the batch's arrivals each, and read again."""
    rows = t[table]
    spark, root = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/buckets/{table}-{uuid.uuid4().hex}"
    schema = T.StructType([f for f in rows.schema.fields if f.name != "updated_at"] + [T.StructField("updated_at", T.TimestampNTZType())])
    whole = rows if "updated_at" in rows.columns else rows.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    write_buckets(whole.select(*schema.names), root, "id")
    middle = changes.select(F.percentile_approx(F.unix_micros(F.col("requested_at").cast("timestamp")), 0.5)).scalar()
    early = F.unix_micros(F.col("requested_at").cast("timestamp")) <= middle
    for name, part in (("early", changes.filter(early)), ("late", changes.filter(~early))):
        run_keyed_changes(spark, t, table, part, root, schema, apply, name)
        run_keyed_changes(spark, t, table, part, root, schema, apply, name)  # published: nothing happens
    return read_buckets(spark, root, schema)


@register("stored_status_changes")
def _job_status(t):
    """W7 as jobs on a bucketed table: what was written equals one application of the whole batch."""
    return _bucketed(t, "sales_orders", t.sales_status_changes,
                     lambda own, ch: W.apply_status_changes(own, "sales_orders", ch, AS_OF_DEFAULT))


@register("stored_client_updates")
def _job_clients(t):
    """W2 as jobs on a bucketed table, unique codes checked against all clients."""
    return _bucketed(t, "clients", t.client_updates,
                     lambda own, ch: W.apply_partial_updates(own, "clients", ch, AS_OF_DEFAULT, stored=t.clients))


@register("kardex_period")
def _k1p(t):
    """K1 of a quarter from a stored ledger: marks of the months before it and its own months' movements."""
    from millbook.operators import periods as P

    rows = t.inventory_movements
    spark, root = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ledgers/{uuid.uuid4().hex}"
    late = F.coalesce(F.col("line_no") % 3 == 0, F.lit(True))  # a second batch with movements of every month
    P.append_ledger(rows.filter(~late), root, "first")
    P.append_ledger(rows.filter(late), root, "second")
    P.append_ledger(rows.filter(late), root, "second")  # repeated: nothing is added twice
    return P.kardex_between(spark, root, "1997-02-10", "1997-05-20")


# ---- reports from maintained sums ---------------------------------------------------------
def _with_sums(t):
    """Tables whose orders are sums kept over three batches: two of orders, one of status changes."""
    from millbook.operators import order_sums as M

    orders = t.sales_orders
    spark, root = orders.sparkSession, f"{shared_dir(orders.sparkSession)}/order-sums/{uuid.uuid4().hex}"
    old = F.col("order_date") < F.lit(RANGE_START).cast("date")
    M.add_orders(orders.filter(old), root, "old")
    M.add_orders(orders.filter(~old | old.isNull()), root, "new")
    for _ in range(2):  # repeated: nothing is counted twice
        after = W.apply_status_changes(t, "sales_orders", t.sales_status_changes, AS_OF_DEFAULT).rows
        M.move_orders(orders, after, root, "moved")
    return t.replace(sales_orders=M.order_sums(spark, root))


@register("maintained_sales_by_client")
def _a1m(t):
    """A1 after W7, from maintained sums."""
    return R.sales_by_client(_with_sums(t), start=RANGE_START, end=RANGE_END)


@register("maintained_sales_kpis")
def _a3m(t):
    """A3 after W7, from maintained sums."""
    return R.sales_kpis(_with_sums(t), AS_OF_DEFAULT, start=FULL_START, end=FULL_END)


@register("maintained_top_clients")
def _a4m(t):
    """A4 after W7, from maintained sums."""
    return R.top_clients(_with_sums(t), AS_OF_DEFAULT, start=FULL_START, end=FULL_END)


@register("maintained_dashboard_kpis")
def _a11m(t):
    """A11 after W7, its sales from maintained sums."""
    return R.dashboard_kpis(_with_sums(t), AS_OF_DEFAULT)
