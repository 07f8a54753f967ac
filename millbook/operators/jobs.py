"""End-to-end batch jobs: one change batch in, every affected table out.

The products snapshot is written last and its pointer carries the batch id, so
it publishes the batch: a rerun of a published batch changes nothing, and a
rerun of one that failed before replaces the batch's appends and starts from
the same stock (load its tables with ``skip_batch``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millbook.operators.changes import ChangeResult
from millbook.operators.intake import intake_sales_orders
from millbook.operators.ledger import apply_movements, numbered_movements
from millbook.sinks.writers import (
    append_rows,
    published,
    read_buckets,
    touched_buckets,
    write_buckets,
    write_report,
    write_snapshot,
)
from millbook.sources.tables import Tables


def _ledger_columns(t: Tables, movements: DataFrame) -> DataFrame:
    have = t.inventory_movements.columns
    return numbered_movements(t, movements.select(*[c for c in movements.columns if c in have and c != "id"])).select(
        *[c for c in have if c == "id" or c in movements.columns])


def run_sales_intake(t: Tables, headers: DataFrame, lines: DataFrame, as_of, out_root: str, batch_id: str,
                     mode: str = "allocate") -> dict[str, str]:
    """W12 as a job: append orders, lines and movements; rejects report; new products snapshot.

    The decisions are checkpointed once and all outputs derive from them.
    """
    paths = {name: os.path.join(out_root, name) for name in
             ("sales_orders", "order_products", "inventory_movements", "products")}
    paths["rejects"] = os.path.join(out_root, "rejects", f"load_id={batch_id}")
    if (done := published(t.products.sparkSession, paths["products"], batch_id)) is not None:
        return paths | {"products": done}
    r = intake_sales_orders(t, headers, lines, as_of, mode=mode, checkpoint=True)
    append_rows(r.sales_orders, paths["sales_orders"], batch_id=batch_id)
    append_rows(r.order_products, paths["order_products"], batch_id=batch_id)
    append_rows(_ledger_columns(t, r.movements), paths["inventory_movements"], batch_id=batch_id)
    write_report(r.rejects, paths["rejects"])
    paths["products"] = write_snapshot(r.stock, paths["products"], batch_id=batch_id)
    return paths


def run_movements(t: Tables, requests: DataFrame, out_root: str, batch_id: str) -> dict[str, str]:
    """W9 as a job: append accepted movements, rejects report, new products snapshot."""
    paths = {"inventory_movements": os.path.join(out_root, "inventory_movements"),
             "rejects": os.path.join(out_root, "movement_rejects", f"load_id={batch_id}"),
             "products": os.path.join(out_root, "products")}
    if (done := published(t.products.sparkSession, paths["products"], batch_id)) is not None:
        return paths | {"products": done}
    r = apply_movements(t, requests, checkpoint=True)
    append_rows(_ledger_columns(t, r.movements), paths["inventory_movements"], batch_id=batch_id)
    write_report(r.rejects, paths["rejects"])
    paths["products"] = write_snapshot(r.stock, paths["products"], batch_id=batch_id)
    return paths


def run_keyed_changes(spark: SparkSession, t: Tables, table: str, changes: DataFrame, root: str, schema,
                      apply: Callable[[Tables, DataFrame], ChangeResult], batch_id: str, key: str = "id") -> list[int]:
    """W2-W5 or W7 as a job on a bucketed table: only the buckets of the batch's keys are read and written.

    ``apply(t, changes)`` is the operator; ``t[table]`` is what those buckets hold,
    so it must change rows by ``key`` alone (unique keys of partial updates are
    checked against ``stored``, the whole table). Rejects go to a report. A batch
    that was published before changes nothing. Returns the buckets written.
    """
    if published(spark, root, batch_id) is not None:
        return []
    only = touched_buckets(changes, key, root)
    result = apply(t.replace(**{table: read_buckets(spark, root, schema, only)}), changes)
    columns = [f.name for f in schema.fields if f.name in result.rows.columns]
    rows = result.rows.select(*columns)
    write_report(result.rejects, f"{root}-rejects/load_id={batch_id}")
    return write_buckets(rows, root, key, batch_id=batch_id, only=only)
