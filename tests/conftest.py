import pytest

from codelode.workspace import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", "4g", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
