"""Physical-plan assertions: no cartesian products, pushdown, pruning, top-k."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = E.queries()
STREAMS = {"stream_stock_balance", "stream_audit_log", "stream_apply_movements", "stream_apply_movements_rejects",
           "stored_movements_kardex", "stored_movements_stock"}
# their rounds run before there is a plan to look at; test_oracle_parity runs them
ROUNDS = {"intake_sales_orders_exact", "intake_sales_orders_exact_rejects", "intake_sales_orders_exact_stock",
          "update_users", "update_users_rejects", "append_users", "append_users_rejects"}


def plan_of(df, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - ROUNDS))
def test_no_cartesian_product(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_date_range_reaches_the_scan(spark):
    p = plan_of(QUERIES["sales_by_client_range"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_columns_are_pruned_at_the_scan(spark):
    p = plan_of(QUERIES["list_suppliers"](spark, SF_SMALL))
    assert "ReadSchema: struct<s_suppkey:bigint,s_name:string>" in p, p


@pytest.mark.parametrize("name", ["critical_stock_top5", "pending_quotes_top5", "active_production_top5",
                                  "top_clients", "list_sales_orders_page"])
def test_top_k_is_not_a_full_sort(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p, name


def test_latest_cost_cuts_history_before_the_shuffle(spark):
    p = plan_of(QUERIES["latest_costs"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", ["sales_by_client", "profit_by_client", "client_outstanding_balance",
                                  "top_clients", "waste_by_process", "apply_client_updates", "upsert_attendance"])
def test_aggregations_combine_map_side(spark, name):
    """A hot key (a third of the rows) is reduced before its shuffle: every
    grouping shows a partial aggregate below its exchange."""
    p = plan_of(QUERIES[name](spark, SF_SMALL), "simple")
    assert "partial_" in p, name


def test_kardex_is_range_partitioned_once(spark):
    """K1 reads the ledger once; the running sum works on (partition, product), never on a whole product."""
    p = plan_of(QUERIES["kardex"](spark, SF_SMALL), "simple")
    assert "lineitem" not in p and p.count("FileScan") == 2  # the staged rows, for the sums and for their totals
    assert "hashpartitioning(_part" in p


def test_dashboard_reads_one_month_of_orders(spark):
    p = plan_of(QUERIES["dashboard_kpis"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in p


def test_profit_values_products_after_summing(spark):
    """Lines meet the orders first; costs join the sums per client and product."""
    p = plan_of(QUERIES["profit_by_client"](spark, SF_SMALL), "simple")
    assert p.index("_unit") < p.index("l_quantity")


def test_stock_fold_is_one_python_stage_over_a_product_partitioning(spark):
    """What follows a shortfall reaches the fold hash-partitioned by product and sorted; the rest reaches no Python."""
    p = plan_of(QUERIES["apply_movements"](spark, SF_SMALL), "simple")
    assert p.count("MapInPandas") == 1 and "Union" in p
    assert "hashpartitioning(product_id" in p and "_nth" in p[p.index("MapInPandas"):]
    assert "rangepartitioning" not in p and "SinglePartition" not in p  # no product is hot there
