import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tremora.session import build_session

    s = build_session("tests", partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small fixture tables from tuples."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
