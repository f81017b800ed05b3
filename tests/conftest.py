import pytest

from scriptorium.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session
