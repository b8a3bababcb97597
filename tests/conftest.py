import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logvars.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SESSION = local_session(cores=8, shuffle_partitions=4)  # test modules build columns when they are loaded


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf():
    return SF
