import pytest

from locusforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
