"""One small session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from reelspark.session import get_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
