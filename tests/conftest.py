import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session
    s = get_session("local[*]", app="quire-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="quire-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def people(spark):
    """The reference's filter fixture (FIXTURES.md: people)."""
    rows = [("John", 30, "john@example.com", "2023-01-15", True),
            ("Jane", 25, "jane@example.com", "2023-03-20", True),
            ("Bob", 35, "bob@example.com", "2022-12-10", False),
            ("Alice", 28, "alice@example.com", "2023-02-05", True),
            ("Charlie", 42, "charlie@example.com", "2022-11-30", False)]
    return spark.createDataFrame(rows, "name string, age long, email string, joinDate string, active boolean")


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="quire-test-")
