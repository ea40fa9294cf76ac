import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corvane.session import get_session

    session = get_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF
