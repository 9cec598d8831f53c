"""Every query against its SQL on DuckDB, at the smallest scale."""

import pytest

import parity
from sparkfolio.plans.catalog import load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*load()])
def test_query_equals_sql(spark, name):
    run, sql = load()[name]
    assert parity.differences(run(spark, SF), sql, SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
