"""One small session for all tests."""

import pytest

from siftlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    return session
