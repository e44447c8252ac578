import os
import tempfile

import pytest

from tessera.session import local_session

os.environ.setdefault("TZ", "UTC")
os.environ["TESSERA_TEST_SOURCES"] = tempfile.mkdtemp(prefix="tessera-sources-")  # before the JVM starts, so that workers have it


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
