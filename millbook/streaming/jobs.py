"""Structured Streaming jobs: T1 running stock, T2 deduplicated audit log,
T3 stock movements with stock checks (stateful fold per slot of products) and their rejects.

State and sink folders live under the shared checkpoint folder of the
session (``spark.checkpoint.dir``); a local session without one gets a
scratch folder (never a cluster: there the setting is required). The jobs
run with ``availableNow`` here and with any trigger in production.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.plans.lineage import shared_dir
from millbook.sources.fixtures import FIXTURE_SQL, fixture_dependencies
from millbook.sources.schemas import DRIVER_SCHEMAS, MONEY


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming job's checkpoint and output."""
    base = spark.conf.get("spark.sql.streaming.checkpointLocation", None) or shared_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def read_driver_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (new parquet files in the folder arrive as new data)."""
    reader = spark.readStream.schema(DRIVER_SCHEMAS[table]).option("pathGlobFilter", f"{table}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def derived_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """An ERP fixture derived from streamed driver rows (same SQL as the batch tables)."""
    deps = {d: read_driver_stream(spark, sf_dir, d, files_per_trigger) for d in fixture_dependencies(name)}
    return spark.sql(FIXTURE_SQL[name], **deps)


# --- T1 -------------------------------------------------------------------------------
def stock_balance_query(movements: DataFrame, root: str, trigger: dict | None = None):
    """Start T1: ``sum(quantity)`` per product in update mode.

    Each micro-batch's updated balances are written to ``{root}/out/epoch=<id>``
    (overwritten when an epoch is replayed, so output is exactly once);
    state is bounded by the number of products, so no watermark is needed.
    """
    agg = movements.groupBy("product_id").agg(F.sum("quantity").alias("balance"))
    out = os.path.join(root, "out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    return (agg.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", os.path.join(root, "state"))
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_balances(spark: SparkSession, root: str) -> DataFrame:
    """Current balance per product: the row of the latest epoch that updated it."""
    out = spark.read.parquet(os.path.join(root, "out"))
    return out.groupBy("product_id").agg(
        F.max_by("balance", "epoch").cast(T.DecimalType(18, 2)).alias("ledger_stock"))


def stream_stock_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 end to end on the ledger derived from streamed line items."""
    root = stream_root(spark, "stock")
    q = stock_balance_query(derived_stream(spark, sf_dir, "inventory_movements"), root)
    q.awaitTermination()
    return latest_balances(spark, root)


# --- T2 -------------------------------------------------------------------------------
def _audit_day(column: str) -> Column:
    return F.coalesce(F.to_date(column), F.lit("1970-01-01").cast("date"))


def logged_ids(spark: SparkSession, out: str, days: list, epoch: int) -> DataFrame:
    """``id, day`` that epochs before ``epoch`` hold on ``days``: only those partitions are read."""
    log = spark.read.schema("id long, epoch long, day date").parquet(out)
    return log.filter(F.col("day").isin(days) & (F.col("epoch") < epoch)).select("id", "day")


def audit_log_query(events: DataFrame, root: str, trigger: dict | None = None):
    """Start T2: append audit events, each id once, however late a copy or an event arrives.

    No watermark drops anything. Each micro-batch keeps the ids the log does
    not hold; a re-delivery repeats the event with its time, so only the log's
    partitions of the batch's days are read: the days are collected (at most one
    per day the batch spans, and none of its rows) and pushed as a literal
    partition filter, so the read grows with the days of a batch, not with the
    log. A micro-batch is written to its own ``epoch`` folder, which a replay
    overwrites (exactly once). No state is kept beside the log.
    """
    out = os.path.join(root, "out")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id"]).withColumn("day", _audit_day("timestamp"))
        if epoch > 0:
            days = [r["day"] for r in batch.select(_audit_day("timestamp").alias("day")).distinct().collect()]
            fresh = fresh.join(logged_ids(spark, out, days, epoch), ["id", "day"], "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(os.path.join(out, f"epoch={epoch}"))

    return (events.writeStream.foreachBatch(write)
            .option("checkpointLocation", os.path.join(root, "state"))
            .trigger(**(trigger or {"availableNow": True})).start())


def read_audit_log(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.schema("id long, user_id long, action string, details string, timestamp timestamp_ntz, "
                              "epoch long, day date").parquet(os.path.join(root, "out")).drop("epoch", "day"))


def stream_audit_log(spark: SparkSession, sf_dir: str, redeliver_errors: bool = True) -> DataFrame:
    """T2 end to end: audit events from the event stream; with ``redeliver_errors``
    the error events arrive a second time and must be dropped by the dedupe."""
    root = stream_root(spark, "audit")
    audits = derived_stream(spark, sf_dir, "audits")
    if redeliver_errors:
        audits = audits.unionByName(audits.filter(F.col("action") == F.lit("ERROR")))
    q = audit_log_query(audits, root)
    q.awaitTermination()
    return read_audit_log(spark, root)


# --- T3: stock movements with stock checks, as a stream --------------------------------
FOLD_SLOTS = 1 << 11  # slots whose products' balances are one state row; fixed for a running stream's state
_DECISION_SCHEMA = (
    "request_id long, requested_at timestamp_ntz, product_id long, user_id long, reference_document string, "
    "is_exit boolean, q_c long, accepted boolean, before_c long, after_c long")
_REQUEST_COLUMNS = ["request_id", "requested_at", "product_id", "movement_type", "quantity", "user_id",
                    "reference_document"]


def _arrival_order(pdf, is_exit):
    """Positions by product and arrival: requested_at, request_id, movement_type, quantity, user_id, reference_document.

    Texts are compared only if requests are equal in all before them.
    """
    import numpy as np
    import pandas as pd

    keys = [pdf["user_id"].fillna(-1).to_numpy(), pdf["q_c"].to_numpy(), is_exit, pdf["request_id"].to_numpy(),
            pdf["requested_at"].to_numpy(), pdf["product_id"].to_numpy()]
    order = np.lexsort(keys)
    same = np.ones(max(len(pdf) - 1, 0), dtype=bool)
    for key in keys:
        told = pd.Series(key[order])
        same &= ((told == told.shift()) | (told.isna() & told.shift().isna())).to_numpy()[1:]
    return np.lexsort([pdf["reference_document"].astype(str).to_numpy(), *keys]) if same.any() else order


def _fold_slot(key, batches, state):
    """The requests of one slot's products in one micro-batch, folded per product in arrival order.

    The state holds the balances in cents of the slot's products seen so far (two
    arrays of 64-bit integers, by product); a product not in it starts from the
    opening stock each request carries. A slot's rows of one micro-batch are
    ordered together (bounded by the trigger size), never its whole history.
    Results are written at each row's own position; balances leave as integer cents.
    """
    import numpy as np
    import pandas as pd

    parts = [b for b in batches if len(b)]
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    n = len(pdf)
    known = {}
    if state.exists:
        ids, cents_left = (np.frombuffer(bytes(b), "<i8").tolist() for b in state.get)
        known = dict(zip(ids, cents_left, strict=True))
    is_exit = pdf["is_exit"].to_numpy()
    order = _arrival_order(pdf, is_exit)
    accepted = np.zeros(n, dtype=bool)
    before = np.zeros(n, dtype=np.int64)
    after = np.zeros(n, dtype=np.int64)
    pids, opened = pdf["product_id"].tolist(), pdf["open_c"].tolist()
    exits, qs = is_exit.tolist(), pdf["q_c"].tolist()
    current, balance = None, 0
    for i in order.tolist():
        if pids[i] != current:
            if current is not None:
                known[current] = balance
            current = pids[i]
            balance = known.get(current, opened[i])
        before[i] = balance
        if not exits[i]:
            balance += qs[i]
            accepted[i] = True
        elif balance >= qs[i]:
            balance -= qs[i]
            accepted[i] = True
        after[i] = balance
    known[current] = balance
    state.update(tuple(np.array(list(column), "<i8").tobytes() for column in (known.keys(), known.values())))
    yield pdf.drop(columns=["_slot", "open_c"], errors="ignore").assign(accepted=accepted, before_c=before, after_c=after)


def movement_decisions_query(requests: DataFrame, products: DataFrame, root: str, trigger: dict | None = None):
    """Start T3: W9 on a stream of movement requests.

    The valid requests are folded per product with ``applyInPandasWithState``, the
    products dealt over ``FOLD_SLOTS`` slots by hash (calling Python for every
    product costs more than folding its rows), and appended to ``{root}/out``; the others (unknown products, other types,
    quantities <= 0) go to the rejects of :func:`invalid_movements_query`, so
    the two outputs hold every request.
    """
    from millbook.functions.money import cents, from_cents

    opening = products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("_stock"))
    valid = (requests.join(opening, "product_id")
             .filter(F.col("movement_type").isin("ENTRY", "EXIT") & (F.col("quantity") > 0))
             .select("request_id", "requested_at", "product_id", "user_id", "reference_document",
                     (F.col("movement_type") == "EXIT").alias("is_exit"), cents("quantity").alias("q_c"),
                     cents(F.coalesce(F.col("_stock"), F.lit(0))).alias("open_c")))
    slot = F.pmod(F.xxhash64("product_id"), F.lit(FOLD_SLOTS))
    decided = valid.withColumn("_slot", slot).groupBy("_slot").applyInPandasWithState(
        _fold_slot, outputStructType=_DECISION_SCHEMA, stateStructType="products binary, balances_c binary",
        outputMode="append", timeoutConf="NoTimeout")
    decided = decided.withColumns({"movement_type": F.when(F.col("is_exit"), "EXIT").otherwise("ENTRY"),
                                   "quantity": from_cents("q_c").cast(MONEY)}).select(
        *_REQUEST_COLUMNS, "accepted", from_cents("before_c").alias("stock_before"), from_cents("after_c").alias("stock_after"))
    return (decided.writeStream.outputMode("append").format("parquet")
            .option("path", os.path.join(root, "out"))
            .option("checkpointLocation", os.path.join(root, "state"))
            .trigger(**(trigger or {"availableNow": True})).start())


def invalid_movements_query(requests: DataFrame, products: DataFrame, root: str, trigger: dict | None = None):
    """Start T3's rejects: ``request_id, product_id, reason`` of requests the W8 checks refuse, to ``{root}/rejects``."""
    from millbook.operators.ledger import validate_movements
    from millbook.sources.tables import Tables

    _valid, rejects = validate_movements(Tables({"products": products}), requests)
    return (rejects.writeStream.outputMode("append").format("parquet")
            .option("path", os.path.join(root, "rejects"))
            .option("checkpointLocation", os.path.join(root, "rejects-state"))
            .trigger(**(trigger or {"availableNow": True})).start())


def _run_movements(spark: SparkSession, sf_dir: str, files_per_trigger: int) -> str:
    from millbook.sources.fixtures import derive_tables

    root = stream_root(spark, "movements")
    products = derive_tables(spark, sf_dir).products
    for start in (movement_decisions_query, invalid_movements_query):
        start(derived_stream(spark, sf_dir, "movement_requests", files_per_trigger), products, root).awaitTermination()
    return root


def stream_apply_movements(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """T3 end to end: movement requests streamed from line items against the product snapshot.

    ``files_per_trigger`` bounds a micro-batch, and with it the rows of one product that are ordered together.
    """
    return spark.read.parquet(os.path.join(_run_movements(spark, sf_dir, files_per_trigger), "out"))


def stream_movement_rejects(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """T3 end to end: every request the stream did not accept, with the reason."""
    root = _run_movements(spark, sf_dir, files_per_trigger)
    short = (spark.read.parquet(os.path.join(root, "out")).filter(~F.col("accepted"))
             .select("request_id", "product_id", F.lit("INSUFFICIENT_STOCK").alias("reason")))
    return short.unionByName(spark.read.parquet(os.path.join(root, "rejects")))
