"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import check
from pelagia.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    result = check.compare(entry_module.queries()[name](spark, SF), con, entry_module.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
