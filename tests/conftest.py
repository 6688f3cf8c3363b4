import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from emberline.session import get_session
    return get_session(app="emberline-tests", master="local[*]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE_DIR
