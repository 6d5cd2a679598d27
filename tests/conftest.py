import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kickframe.session import local_session, ship_package

    session = local_session(4, 4)
    ship_package(session)
    yield session
    session.stop()
