"""Change application W1-W8, W15, W16: batches of write requests as Spark jobs.

A change set is a DataFrame of requests, each with ``request_id`` and
``requested_at`` (arrival order). Every job returns the rows it writes (or
the new snapshot of the table) and a rejects frame ``(request_id, reason)``;
accepted + rejected = input. Checks read the snapshot at the start of the
batch, but for unique keys, which follow the batch as it unfolds. Several requests for one key are collapsed with aggregates that
combine map-side (``max_by`` on the arrival order), so a key that holds a
large share of the batch never sits in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions import dates as D
from millbook.functions.keys import keys_present
from millbook.functions.money import num_or, text_or
from millbook.functions.paging import dense_number
from millbook.operators.ownership import resolve_keys
from millbook.sources.schemas import MONEY
from millbook.sources.tables import Tables

ARRIVAL = ("requested_at", "request_id")


@dataclass
class ChangeResult:
    rows: DataFrame      # rows written (appended rows, or the new snapshot)
    rejects: DataFrame   # request_id, reason


def _arrival() -> Column:
    return F.struct(*[F.col(c) for c in ARRIVAL])


def _now(as_of) -> Column:
    """CURRENT_TIMESTAMP stand-in: midnight of ``as_of`` (a wall-clock literal, no time zone)."""
    return F.lit(f"{D.as_date(as_of).isoformat()} 00:00:00").cast(T.TimestampNTZType())


def _stamp(base: DataFrame, touched: Column, as_of) -> Column:
    """``updated_at`` of a snapshot: now on touched rows, what the table has on the others."""
    stamp = F.when(touched, _now(as_of))
    if "updated_at" in base.columns:
        stamp = stamp.otherwise(F.col("updated_at"))
    return stamp.cast(T.TimestampNTZType())


def _reject(df: DataFrame, cond: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` on ``cond``: (kept, rejects with ``reason``). NULL conditions keep the row."""
    flagged = df.withColumn("_bad", F.coalesce(cond, F.lit(False)))
    return (flagged.filter(~F.col("_bad")).drop("_bad"),
            flagged.filter("_bad").select("request_id", F.lit(reason).alias("reason")))


def _empty_rejects(df: DataFrame) -> DataFrame:
    return df.select("request_id", F.lit(None).cast(T.StringType()).alias("reason")).limit(0)


# --- W8: validation rules --------------------------------------------------------------
def reject_missing(df: DataFrame, column: str, reason: str = "REQUIRED_FIELD_MISSING"):
    """NULL, and what counts as missing in a request: an empty text or a 0."""
    kind = df.schema[column].dataType
    empty = F.lit(False)
    if isinstance(kind, T.StringType):
        empty = F.col(column) == ""
    elif isinstance(kind, T.NumericType):
        empty = F.col(column) == 0
    return _reject(df, F.col(column).isNull() | empty, f"{reason}:{column}")


def reject_not_positive(df: DataFrame, column: str):
    return _reject(df, F.col(column).isNull() | (F.col(column) <= 0), f"NOT_POSITIVE:{column}")


def reject_not_allowed(df: DataFrame, column: str, allowed: tuple[str, ...]):
    return _reject(df, F.col(column).isNull() | ~F.col(column).isin(*allowed), f"NOT_ALLOWED:{column}")


def reject_missing_reference(df: DataFrame, column: str, target: DataFrame, reason: str):
    """Requests whose ``column`` has no row in ``target`` (by its ``id``)."""
    ref = keys_present(target, "id", df, column, alias="_ref_id")
    joined = df.join(ref, df[column] == ref["_ref_id"], "left")
    return _reject(joined, F.col("_ref_id").isNull(), reason)


def _known_ids(target: DataFrame, requests: DataFrame) -> DataFrame:
    """Ids of ``target`` named by the requests, as ``_tid``."""
    return keys_present(target, "id", requests, "id", alias="_tid")


def _drop_ref(df: DataFrame) -> DataFrame:
    return df.drop("_ref_id") if "_ref_id" in df.columns else df


def reject_duplicate_key(df: DataFrame, key: str, existing: DataFrame, reason: str):
    """Unique-key check (23505): a key already stored, or an earlier request in
    the batch with the same key, rejects the request. NULL keys never collide.

    The earliest request per key is found with a ``min`` aggregate (combined
    map-side), not a window, so a hot key does not gather in one task.
    """
    stored = keys_present(existing, key, df, key).withColumn("_stored", F.lit(True))
    first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(_arrival()).alias("_first"))
    j = (df.join(stored, df[key] == stored["_k"], "left").drop("_k")
         .join(first, df[key] == first["_k"], "left").drop("_k"))
    dup = F.col("_stored") | (_arrival() != F.col("_first"))
    kept, rej = _reject(j, dup, reason)
    return kept.drop("_stored", "_first"), rej


def reject_taken_keys(df: DataFrame, keys: dict[str, str], existing: DataFrame, holder: str | None = "id",
                      sets: dict[str, Column] | None = None):
    """Unique-key check of updates and of rows with several keys, as the batch unfolds.

    A request is rejected if another row holds one of its keys at its turn: a key
    that an earlier accepted request freed is free, and one that a rejected request
    asked for was never taken (:func:`millbook.operators.ownership.resolve_keys`).
    """
    told, _rounds = resolve_keys(df, existing, keys, ARRIVAL, holder, sets)
    return (told.filter(F.col("reason").isNull()).drop("reason"),
            told.filter(F.col("reason").isNotNull()).select("request_id", "reason"))


# What the reference's endpoints require of an insert, in their order of checking
# (fixed values): positive amounts, required fields, allowed values.
POSITIVE = {"incomes": ("amount",), "expenses": ("amount",), "shifts": ("duration",), "wastes": ("quantity",)}
REQUIRED = {"incomes": ("date", "source"), "expenses": ("date", "category"), "shifts": ("employee_id", "date"),
            "users": ("username", "role", "employee_id")}
ALLOWED = {"wastes": {"process": ("EXTRUSION", "BLOWING")}}
UNIQUE_KEYS = {"users": {"username": "DUPLICATE_USERNAME", "email": "DUPLICATE_EMAIL",
                         "employee_id": "DUPLICATE_EMPLOYEE"},
               "products": {"sku": "DUPLICATE_SKU"}, "clients": {"code": "DUPLICATE_CODE"}}


def standard_checks(t: Tables, table: str) -> list:
    """The W8 checks every insert into ``table`` passes: allowed values, amounts, required fields, unique keys."""
    checks = []
    for column, allowed in ALLOWED.get(table, {}).items():
        checks.append(lambda df, c=column, a=allowed: reject_not_allowed(df, c, a))
    for column in POSITIVE.get(table, ()):
        checks.append(lambda df, c=column: reject_not_positive(df, c))
    for column in REQUIRED.get(table, ()):
        checks.append(lambda df, c=column: reject_missing(df, c))
    unique = UNIQUE_KEYS.get(table, {})
    if len(unique) > 1:  # a request that one key sinks does not claim the others
        checks.append(lambda df: reject_taken_keys(df, unique, t[table], holder=None))
    for key, reason in unique.items() if len(unique) == 1 else ():
        checks.append(lambda df, k=key, r=reason: reject_duplicate_key(df, k, t[table], r))
    return checks


# --- W1: inserts with defaults -----------------------------------------------------------
# Per-table defaults of inserted rows (fixed values of the reference's create functions).
def _defaults(table: str, as_of) -> dict[str, Column]:
    now = _now(as_of)
    if table == "clients":
        return {"credit_limit": num_or("credit_limit", F.lit(0).cast(MONEY)),
                "payment_terms": num_or("payment_terms", F.lit(30)).cast(T.IntegerType()),
                "is_active": F.lit(True)}
    if table == "products":
        return {"type": text_or("type", "FINISHED_PRODUCT"),
                "min_stock": num_or("min_stock", F.lit(0).cast(MONEY)),
                "current_stock": F.lit(0).cast(MONEY), "is_active": F.lit(True)}
    if table == "employees":
        return {"shift": text_or("shift", "MORNING"),
                "salary": F.nullif(F.col("salary"), F.lit(0)), "is_active": F.lit(True)}
    if table == "incomes":
        return {"invoice_id": F.nullif(F.col("invoice_id"), F.lit(0))}
    if table == "expenses":
        return {"supplier_id": F.nullif(F.col("supplier_id"), F.lit(0))}
    if table == "wastes":
        return {"date": now}
    if table == "users":
        return {"is_active": F.lit(True)}
    if table == "production_orders":
        return {"status": F.lit("PENDING"), "priority": text_or("priority", "MEDIUM")}
    return {}


def _next_ids(existing: DataFrame, requests: DataFrame, name: str = "id",
              keys: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Ids after the stored maximum, in arrival order (the sequence stand-in)."""
    top = existing.select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return dense_number(requests, list(keys), name=name, start=top + F.lit(1))


def append_with_defaults(t: Tables, table: str, requests: DataFrame, as_of,
                         checks: list | None = None) -> ChangeResult:
    """Insert requests into ``table`` with its defaults and new ids.

    ``checks`` are W8 functions ``df -> (kept, rejects)`` applied first, then
    the table's :func:`standard_checks`. Production orders get
    ``OP-yyyymmdd-id`` numbers; wastes need an existing production order.
    Returns the appended rows in the table's columns.
    """
    existing = t[table]
    kept, rejects = requests, [_empty_rejects(requests)]
    every = [*(checks or []), *standard_checks(t, table)]
    if table == "wastes":
        every.append(lambda df: reject_missing_reference(df, "order_id", t.production_orders, "ORDER_NOT_FOUND"))
    for check in every:
        kept, r = check(kept)
        kept = _drop_ref(kept)
        rejects.append(r)
    for col, expr in _defaults(table, as_of).items():
        kept = kept.withColumn(col, expr)
    # arrival order, then every other request column: identical requests may share
    # (requested_at, request_id) and still number deterministically up to swapping equals
    keys = (*ARRIVAL, *[f.name for f in requests.schema.fields
                        if f.name not in ARRIVAL and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])
    numbered = _next_ids(existing, kept, keys=keys)
    if table == "production_orders":
        stamp = D.as_date(as_of).strftime("%Y%m%d")
        numbered = numbered.withColumn(
            "order_number", F.concat(F.lit(f"OP-{stamp}-"), F.col("id").cast(T.StringType())))
    cols = [F.col(c).cast(existing.schema[c].dataType).alias(c) if c in numbered.columns
            else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns]
    rows = numbered.select(*cols, *[c for c in ARRIVAL])
    out_rejects = rejects[0]
    for r in rejects[1:]:
        out_rejects = out_rejects.unionByName(r)
    return ChangeResult(rows, out_rejects)


# --- W2: partial updates -----------------------------------------------------------------
# Columns a partial update may not set, per table (fixed by the reference's update functions).
NOT_SETTABLE = {
    "clients": ("id", "created_at", "updated_at"),
    "employees": ("id", "created_at", "updated_at"),
    "products": ("id", "updated_at"),
    "shifts": ("id",),
}
ACTIVE_ONLY = {"clients": True, "employees": True, "products": True, "shifts": False}
STAMPS_UPDATED_AT = {"clients": True, "employees": True, "products": True, "shifts": False}


def _set_list(changes: DataFrame) -> Column:
    """The supplied-column list: an array column, or comma-separated text."""
    field = changes.schema["set_columns"].dataType
    if isinstance(field, T.ArrayType):
        return F.col("set_columns")
    return F.split(F.coalesce(F.col("set_columns"), F.lit("")), ",")


def apply_partial_updates(t: Tables, table: str, changes: DataFrame, as_of, stored: DataFrame | None = None) -> ChangeResult:
    """Set only the supplied columns (``set_columns``), latest request per column wins.

    An explicitly supplied NULL is a value; an absent column keeps the stored
    one. Only active rows of clients, products, employees can change (shifts
    any row); a request for a missing row is rejected NOT_FOUND. A request
    that supplies no settable column changes nothing; one that sets a unique
    key another row holds at its turn is rejected (:func:`reject_taken_keys`). Clients, products and
    employees get ``updated_at = now`` on rows where some column changed
    (the column is added when the stored table has none); shifts have no
    ``updated_at``. ``stored``: all rows that hold unique keys, where ``t`` has
    only those the batch may change.
    """
    base = t[table]
    settable = [c for c in base.columns if c not in NOT_SETTABLE[table] and c in changes.columns]
    ch = changes.withColumn("_set", _set_list(changes))
    target = base.filter(F.col("is_active")) if ACTIVE_ONLY[table] else base
    ids = _known_ids(target, ch)
    j = ch.join(ids, ch["id"] == ids["_tid"], "left")
    valid, rejects = _reject(j, F.col("_tid").isNull(), "NOT_FOUND")
    valid = valid.drop("_tid")
    unique = {k: reason for k, reason in UNIQUE_KEYS.get(table, {}).items() if k in settable}
    if unique:
        sets = {k: F.coalesce(F.array_contains(F.col("_set"), F.lit(k)), F.lit(False)) for k in unique}
        valid, r = reject_taken_keys(valid, unique, base if stored is None else stored, sets=sets)
        rejects = rejects.unionByName(r)
    aggs = []
    for c in settable:
        supplied = F.array_contains(F.col("_set"), F.lit(c))
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")), F.when(supplied, _arrival())).alias(f"_n_{c}"))
    collapsed = valid.groupBy("id").agg(*aggs) if aggs else valid.select("id").distinct()
    touched = F.lit(False)
    for c in settable:
        touched = touched | F.col(f"_n_{c}").isNotNull()
    merged = base.join(collapsed, "id", "left")
    out = []
    for c in base.columns:
        if c in settable:
            out.append(F.when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}.v")).otherwise(F.col(c))
                       .cast(base.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    snapshot = merged.select(*out, touched.alias("_touched"))
    if STAMPS_UPDATED_AT[table]:
        snapshot = snapshot.withColumn("updated_at", _stamp(base, F.col("_touched"), as_of))
    return ChangeResult(snapshot.drop("_touched"), rejects)


# --- W3: whole-row user updates ------------------------------------------------------------
USER_FIELDS = ("username", "email", "role", "employee_id", "is_active")


def update_users(t: Tables, changes: DataFrame, as_of, stored: DataFrame | None = None) -> ChangeResult:
    """Replace username, email, role, employee_id, is_active as a whole
    (absent = NULL), for users in any state; the latest request per id wins.

    A username, email or employee link that another user holds at the request's
    turn rejects it (:func:`reject_taken_keys`): names may be swapped or passed on
    inside a batch. ``stored`` as in :func:`apply_partial_updates`.
    """
    ids = _known_ids(t.users, changes)
    j = changes.join(ids, changes["id"] == ids["_tid"], "left")
    valid, rejects = _reject(j, F.col("_tid").isNull(), "NOT_FOUND")
    valid = valid.drop("_tid")
    valid, r = reject_taken_keys(valid, UNIQUE_KEYS["users"], t.users if stored is None else stored)
    rejects = rejects.unionByName(r)
    latest = valid.groupBy("id").agg(
        F.max_by(F.struct(*[F.col(c) for c in USER_FIELDS]), _arrival()).alias("_n"))
    merged = t.users.join(latest, "id", "left")
    cols = [F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c))
            .cast(t.users.schema[c].dataType).alias(c) if c in USER_FIELDS else F.col(c)
            for c in t.users.columns if c != "updated_at"]
    snapshot = merged.select(*cols, _stamp(t.users, F.col("_n").isNotNull(), as_of).alias("updated_at"))
    return ChangeResult(snapshot, rejects)


# --- W4 / W5: deletes -----------------------------------------------------------------------
DELETE_NEEDS_ACTIVE = {"products": True, "clients": False, "employees": False, "users": False}


def soft_delete(t: Tables, table: str, requests: DataFrame, as_of) -> ChangeResult:
    """``is_active = FALSE`` and ``updated_at = now`` for the requested ids.

    Products must be active to be deleted; clients, employees and users are
    stamped again even when already inactive. Unknown ids are rejected.
    """
    base = t[table]
    target = base.filter(F.col("is_active")) if DELETE_NEEDS_ACTIVE[table] else base
    ids = _known_ids(target, requests)
    j = requests.join(ids, requests["id"] == ids["_tid"], "left")
    valid, rejects = _reject(j, F.col("_tid").isNull(), "NOT_FOUND")
    hit = valid.select(F.col("id").alias("_hid")).distinct()
    merged = base.join(hit, base["id"] == hit["_hid"], "left")
    deleted = F.col("_hid").isNotNull()
    snapshot = (merged.withColumn("is_active", F.when(deleted, F.lit(False)).otherwise(F.col("is_active")))
                .withColumn("updated_at", _stamp(base, deleted, as_of)).drop("_hid"))
    return ChangeResult(snapshot, rejects)


def hard_delete_shifts(t: Tables, requests: DataFrame) -> ChangeResult:
    """Remove shifts by id (anti-join); unknown ids are rejected."""
    ids = _known_ids(t.shifts, requests)
    j = requests.join(ids, requests["id"] == ids["_tid"], "left")
    valid, rejects = _reject(j, F.col("_tid").isNull(), "NOT_FOUND")
    snapshot = t.shifts.join(valid.select("id"), "id", "left_anti")
    return ChangeResult(snapshot, rejects)


# --- W6: attendance upsert --------------------------------------------------------------------
ATTENDANCE_FIELDS = ("entry_time", "exit_time", "absence_reason", "overtime_hours")


def upsert_attendance(t: Tables, changes: DataFrame) -> ChangeResult:
    """Insert per (employee_id, date) or ``coalesce(new, old)`` per column.

    Inputs ``0`` / ``''`` count as NULL (``x || null``), so they never
    overwrite. Several changes to one key apply in arrival order, which makes
    each column the latest non-NULL supplied value, else the stored one. New
    keys get ids after the stored maximum, in order of their first request.
    """
    cleaned = changes.select(
        "request_id", "requested_at", "employee_id", "date",
        F.col("entry_time"), F.col("exit_time"),
        F.nullif(F.col("absence_reason"), F.lit("")).alias("absence_reason"),
        F.nullif(F.col("overtime_hours"), F.lit(0)).alias("overtime_hours"))
    valid, rejects = reject_missing(cleaned, "employee_id")
    valid, r2 = reject_missing(valid, "date")
    collapsed = valid.groupBy("employee_id", "date").agg(
        F.min(_arrival()).alias("_first"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), _arrival())).alias(f"_n_{c}") for c in ATTENDANCE_FIELDS])
    att = t.attendances
    keys = ["employee_id", "date"]
    # stored rows take the batch's values through a left join (the collapsed
    # batch is the side that can be broadcast); new keys are the batch keys
    # without a stored row, found against stored keys reduced to the batch's
    existing = att.join(collapsed, keys, "left").select(
        "id", *keys, *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).cast(att.schema[c].dataType).alias(c)
                       for c in ATTENDANCE_FIELDS])
    stored_keys = att.select(*keys).join(collapsed.select(*keys), keys, "left_semi")
    fresh = collapsed.join(stored_keys, keys, "left_anti").select(
        *keys, *[F.col(f"_n_{c}").cast(att.schema[c].dataType).alias(c) for c in ATTENDANCE_FIELDS],
        F.col("_first.requested_at").alias("requested_at"), F.col("_first.request_id").alias("request_id"))
    fresh = _next_ids(att, fresh).drop(*ARRIVAL)
    snapshot = existing.unionByName(fresh.select(*existing.columns))
    return ChangeResult(snapshot.select(*att.columns), rejects.unionByName(r2))


# --- W7: status changes ----------------------------------------------------------------------
# Allowed target statuses per table (fixed values of the reference's status endpoints).
STATUS_ALLOWED = {
    "sales_orders": ("CONFIRMED", "IN_PROGRESS", "COMPLETED", "CANCELLED"),
    "production_orders": ("PENDING", "IN_PROGRESS", "COMPLETED", "CANCELLED"),
}


def apply_status_changes(t: Tables, table: str, changes: DataFrame, as_of) -> ChangeResult:
    """Set ``status`` (and ``updated_at``) to the latest allowed request per id.

    Any transition is allowed; statuses outside the table's list and unknown
    ids are rejected. Cancelling returns no stock.
    """
    base = t[table]
    ok, rejects = reject_not_allowed(changes, "status", STATUS_ALLOWED[table])
    ids = _known_ids(base, ok)
    j = ok.join(ids, ok["id"] == ids["_tid"], "left")
    valid, r2 = _reject(j, F.col("_tid").isNull(), "NOT_FOUND")
    order = F.struct(*[F.col(c) for c in ARRIVAL], F.col("status"))  # status breaks exact ties
    latest = valid.groupBy("id").agg(F.max_by(F.col("status"), order).alias("_status"))
    merged = base.join(latest, "id", "left")
    snapshot = (merged.withColumn("status", F.coalesce(F.col("_status"), F.col("status")))
                .withColumn("updated_at", _stamp(base, F.col("_status").isNotNull(), as_of)).drop("_status"))
    return ChangeResult(snapshot, rejects.unionByName(r2))


# --- W15: costings ---------------------------------------------------------------------------
def intake_costings(t: Tables, requests: DataFrame, as_of) -> ChangeResult:
    """Costing rows with ``total = material + labor + waste`` (missing or 0
    parts count 0). Product and ``calculation_date`` are required, and the
    product must exist. ``as_of`` is not used."""
    kept, missing = reject_missing(requests, "product_id")
    kept, undated = reject_missing(kept, "calculation_date")
    kept, unknown = reject_missing_reference(kept, "product_id", t.products, "PRODUCT_NOT_FOUND")
    kept, rejects = _drop_ref(kept), missing.unionByName(undated).unionByName(unknown)
    parts = {c: num_or(c, F.lit(0)).cast(MONEY) for c in ("material_cost", "labor_cost", "waste_cost")}
    rows = kept.select(
        "request_id", "product_id", *[v.alias(k) for k, v in parts.items()],
        (parts["material_cost"] + parts["labor_cost"] + parts["waste_cost"]).cast(MONEY).alias("total"),
        "calculation_date")
    return ChangeResult(rows, rejects)


# --- W16: audit events -----------------------------------------------------------------------
def audit_events(user_id: Column, action: str, details: Column, at: Column) -> list[Column]:
    return [user_id.alias("user_id"), F.lit(action).alias("action"), F.to_json(details).alias("details"),
            at.cast(T.TimestampNTZType()).alias("timestamp")]


def append_audit(t: Tables, created: DataFrame | None = None, updated: DataFrame | None = None,
                 deleted: DataFrame | None = None, movements: DataFrame | None = None,
                 start_id: Column | None = None) -> DataFrame:
    """Audit rows for product creates/updates/deletes and stock movements.

    Each input is the accepted output of W1/W2/W4/W9 with ``user_id`` and
    ``requested_at`` (movements with the ``id`` that W9 gives them); details are the JSON the inventory module logs. Ids
    continue after the stored maximum in arrival order.
    """
    parts = []
    if created is not None:
        parts.append(created.select(*audit_events(F.col("user_id"), "CREATE_PRODUCT",
                                                  F.struct(F.col("id").alias("productId"), "sku"),
                                                  F.col("requested_at")), "request_id"))
    if updated is not None:
        parts.append(updated.select(*audit_events(F.col("user_id"), "UPDATE_PRODUCT",
                                                  F.struct(F.col("id").alias("productId"),
                                                           F.col("changes")),
                                                  F.col("requested_at")), "request_id"))
    if deleted is not None:
        parts.append(deleted.select(*audit_events(F.col("user_id"), "DELETE_PRODUCT",
                                                  F.struct(F.col("id").alias("productId")),
                                                  F.col("requested_at")), "request_id"))
    if movements is not None:
        for kind, action in (("ENTRY", "INVENTORY_ENTRY"), ("EXIT", "INVENTORY_EXIT")):
            parts.append(movements.filter(F.col("movement_type") == kind).select(
                *audit_events(F.col("user_id"), action,
                              F.struct(F.col("id").alias("movementId"),
                                       F.col("product_id").alias("productId"), F.col("quantity")),
                              F.col("requested_at")), "request_id"))
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    events = events.withColumn("requested_at", F.col("timestamp"))
    # every column in the key: only identical events tie, so numbering is deterministic
    numbered = _next_ids(t.audits, events, keys=("requested_at", "request_id", "action", "details", "user_id")) \
        .drop("requested_at", "request_id")
    return numbered.select("id", "user_id", "action", "details", "timestamp")
