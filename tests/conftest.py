import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flowloom.session import local_session

    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a DDL schema."""
    def build(data, schema):
        return spark.createDataFrame(data, schema)

    return build
