import os

import pytest

from assayer.session import local_session

SMALL = "/root/testdata/sf0.001"

# Python workers import the stand-ins that the test modules define.
os.environ["PYTHONPATH"] = os.pathsep.join(
    filter(None, [os.path.dirname(__file__), os.environ.get("PYTHONPATH")])
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL
