"""Every registered query runs; those with SQL agree with it on the small tables."""

import os

import pytest

from flowloom.plans import catalog
from flowloom.plans.adapters import Tables
from tests.oracle import compare, connect, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    got = spark_rows(REGISTRY[name].build(Tables(spark, SF)))
    sql = REGISTRY[name].sql
    if sql:
        assert compare(got, duck_rows(duck, sql)) is None
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
