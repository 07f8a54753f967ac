"""Every registered query against its DuckDB oracle (row multiset equality)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import frame_hash

from millbook import catalog, oracle

QUERIES = catalog.queries()
ORACLE = oracle.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck_small, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck_small.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got)[0] == frame_hash(want)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["client_id", "client_name", "total_orders", "total_revenue", "total_cost", "total_profit"]
