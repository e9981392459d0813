import pytest

from webloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()
