import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))


@pytest.fixture(scope="session")
def spark():
    from worklens.session import local_session, ship

    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
