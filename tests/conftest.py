import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from callsight.session import local_session, remove_scratch

    s = local_session(cores=4, shuffle_partitions=8, app="callsight-tests")
    yield s
    remove_scratch(s)
    s.stop()


SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
