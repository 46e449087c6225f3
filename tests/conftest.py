import sys

import pytest

sys.path.insert(0, "/root/repo")

from tidewatch.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_groups(spark):
    """Force the cell path: every key counts as too large for a plain window."""
    spark.conf.set("spark.tidewatch.maxGroupRows", "3")
    yield
    spark.conf.unset("spark.tidewatch.maxGroupRows")
