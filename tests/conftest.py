import pytest

from ledgerlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("OFF")
    # Plans are read in full.
    session.conf.set("spark.sql.debug.maxToStringFields", "1000")
    session.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield session
    session.stop()
