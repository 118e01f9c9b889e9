import pytest

from cropscan.session import build_session, discard_intermediates

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, app="cropscan-tests", **{"spark.driver.memory": "8g"})
    yield session
    discard_intermediates(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
