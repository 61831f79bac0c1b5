import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recalloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


def value(spark, column, **cells):
    """Evaluate one column expression over one row of literals."""
    row = spark.createDataFrame([tuple(cells.values())], list(cells))
    return row.select(column).first()[0]
