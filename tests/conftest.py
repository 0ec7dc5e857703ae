import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wearline.session import TASK_BYTES_KEY, build_session

    session = build_session("wearline-tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set(TASK_BYTES_KEY, str(2**80))  # fixtures have no size statistics; split plans are asked for by name
    yield session
    session.stop()
