"""Every registered query against its DuckDB oracle on the smallest data."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from larder.plans.registry import REGISTRY
from oracle_check import compare, duck_connection

QUERIES = {name: q for name, q in entry.queries().items() if name in REGISTRY}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(REGISTRY) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    res = compare(spark, duck, name, SF_SMALL, QUERIES[name], SQL[name])
    assert res["status"] == "ok", res
