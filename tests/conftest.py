import os

import pytest

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.files.maxPartitionBytes": "4m"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA
