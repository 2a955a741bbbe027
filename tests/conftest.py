import pytest

from plumbline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
