import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rolesieve.session import local_session

    session = local_session("8", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows([dict, ...], schema) -> DataFrame."""

    def make(records, schema):
        names = [part.split()[0].strip("`") for part in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)

    return make
