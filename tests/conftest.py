import pytest

from tideframe.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__memory="4g")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
