import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gridcast.session import build_session, drop_staged

    session = build_session("gridcast-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
