"""Every registered query equals its SQL; the entry module works without the llm folders."""

import pytest

from tests.oracle import connect, spark_rows, sql_rows
from verilake.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == sql_rows(con, registry.ORACLES[name])


def test_file_listing(spark, sf):
    names = {r["name"] for r in registry.QUERIES["catalog_scan_files"](spark, sf).collect()}
    assert "documents.parquet" in names


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_no_whole_table_window(spark, sf):
    """No query deals a large table into one partition for a window."""
    plan = registry.QUERIES["work_order"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
