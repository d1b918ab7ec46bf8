import pytest

from tidemark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", master="local[4]", spark__driver__memory="4g", spark__sql__shuffle__partitions="4", spark__sql__defaultSizeInBytes="1000000")  # tables made in tests are small
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
