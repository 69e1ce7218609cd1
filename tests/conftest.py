import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from jobsmith.session import local_session

    s = local_session("*", shuffle_partitions=8, app="jobsmith-tests")
    yield s
    s.stop()


SMOKE = "/root/testdata/sf0.001"
