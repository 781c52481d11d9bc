import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hazardlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def rows(frame, *order):
    """Rows as tuples, sorted so that they can be compared."""
    return sorted((tuple(row) for row in frame.select(*order or frame.columns).collect()), key=repr)
