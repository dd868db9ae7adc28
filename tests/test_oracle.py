"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate: row count, column names, order-insensitive value hash)."""

import pytest

from compare import compare, duck
from conftest import SF01
from proselens.plans import catalog, oracle

QUERIES = catalog.QUERIES
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in SQL, f"{name} has no oracle SQL"
    res = compare(spark, con, name, QUERIES[name], SQL[name], SF01)
    assert res["status"] == "ok", res
