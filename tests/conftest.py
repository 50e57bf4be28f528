import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from splitwright.session import Workspace, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
