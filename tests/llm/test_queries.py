"""Every registered query with SQL against DuckDB on the smallest scale; the others run in their own tests."""

import pytest

from ragscope.llm.queries import ORACLES, QUERIES
from ragscope.plans.oracle_check import compare, duckdb_conn
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "ok" and r["spark_rows"] > 10, r


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_numbers_and_columns(name):
    assert name.startswith("op") and name[2:].split("_")[0].isdigit()
