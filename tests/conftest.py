import pytest

from shelfspark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
