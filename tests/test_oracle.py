"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import oracle_check as check
import pytest

import __spark_entry__ as entry
from mediaspark.plans import catalog

DIR = "/root/testdata/sf0.001"
SQL = catalog.ORACLES
#: Iterative numerics and a picture filter with memory; ``test_lines`` and ``test_audio_transport`` compare them with plain Python.
WITHOUT_SQL = {"pca", "vq_codebook", "temporal_denoise"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message = check.compare(spark, DIR, con, name, catalog.QUERIES[name], SQL.get(name))
    assert ok, message


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_have_sql():
    assert set(catalog.QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
