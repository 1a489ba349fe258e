import pytest

from filinglake.session import get_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
