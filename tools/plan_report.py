"""Summarize the physical plan of every registered batch query into PLANS.md.

Counts come from the plan Spark prints with ``explain()`` before execution
(AQE may still turn a sort-merge join into a broadcast at run time when the
measured side is small). Usage: python tools/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STREAMS = {"stream_stock_balance", "stream_audit_log", "stream_apply_movements", "stream_apply_movements_rejects",
           "stored_movements_kardex", "stored_movements_stock"}
# these run in rounds of jobs before there is a plan to show
ROUNDS = {"intake_sales_orders_exact", "intake_sales_orders_exact_rejects", "intake_sales_orders_exact_stock",
          "update_users", "update_users_rejects", "append_users", "append_users_rejects"}


def facts(plan: str) -> dict:
    physical = plan.split("== Physical Plan ==")[-1]
    initial = physical.split("+- == Initial Plan ==")[-1] if "Initial Plan" in physical else physical
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", initial)),
        "range": len(re.findall(r"Exchange rangepartitioning", initial)),
        "single": len(re.findall(r"Exchange SinglePartition", initial)),
        "bcast": len(re.findall(r"BroadcastExchange", initial)),
        "smj": len(re.findall(r"SortMergeJoin", initial)),
        "bhj": len(re.findall(r"BroadcastHashJoin", initial)),
        "topk": "TakeOrderedAndProject" in initial,
        "wgl": "WindowGroupLimit" in initial,
        "python": bool(re.search(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", initial)),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", initial)) - {""}),
        "cartesian": "CartesianProduct" in initial or "BroadcastNestedLoopJoin" in initial,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "PLANS.md")
    from millbook.session import build_session
    from millbook import catalog

    spark = build_session("local[8]", shuffle_partitions=16)
    rows = []
    for name, fn in sorted(catalog.queries().items()):
        if name in STREAMS | ROUNDS:
            continue
        df = fn(spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        f = facts(plan)
        pushed = "; ".join(p for p in f["pushed"] if p not in ("IsNotNull(l_orderkey)",))[:90]
        rows.append(f"| `{name}` | {f['hash']} | {f['range']} | {f['single']} | {f['bcast']} | {f['smj']} | "
                    f"{'yes' if f['topk'] else ''} | {'yes' if f['wgl'] else ''} | {'yes' if f['python'] else ''} | "
                    f"{'YES' if f['cartesian'] else ''} | {pushed} |")
    header = (
        "# PLANS\n\n"
        "Physical plans of every registered batch query as planned at "
        f"`{sf_dir}` (`tools/plan_report.py`, 16 shuffle partitions). Columns: hash / range / single-partition\n"
        "shuffles, broadcast exchanges, sort-merge joins (AQE may still convert one to a broadcast when the\n"
        "measured side is small), distributed top-k, map-side window group limit, Python in a task,\n"
        "cartesian products (must be empty), filters pushed into the parquet scans.\n\n"
        "Single-partition exchanges only carry one-row partial aggregates (global counts and sums) or\n"
        "the per-partition offsets of `dense_number`.\n\n"
        "| Query | hash | range | single | bcast | SMJ | top-k | WGL | Python | cartesian | pushed filters |\n"
        "|---|---|---|---|---|---|---|---|---|---|---|\n")
    appendix = ["\n## Full plans of the heaviest queries\n"]
    for name in ("profit_by_client", "kardex", "apply_movements", "intake_sales_orders"):
        df = catalog.queries()[name](spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        plan = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", plan)
        appendix.append(f"### `{name}`\n\n```\n{plan.strip()}\n```\n")
    with open(out, "w") as fh:
        fh.write(header + "\n".join(rows) + "\n" + "\n".join(appendix))
    print(f"wrote {out} ({len(rows)} queries)")


if __name__ == "__main__":
    main()
