import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tests.harness import session
    from ordertide.session import prepare
    s = prepare(session())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
