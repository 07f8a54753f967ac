import os
import sys
import tempfile

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    from millbook.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=8)
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="millbook-test-ckpt-"))
    yield s
    s.stop()


def duck_for(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck_small():
    return duck_for(SF_SMALL)


@pytest.fixture(scope="session")
def tables_small(spark):
    from millbook.sources.fixtures import derive_tables
    return derive_tables(spark, SF_SMALL)
