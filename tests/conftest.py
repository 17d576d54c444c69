import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gridfold.session import get_session
    s = get_session("local[4]", "gridfold-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def grid_small(spark):
    """A 4 x 6 grid (0.5 degree, x0=0, y0=2) for edge tests."""
    from gridfold.model import GridSpec
    return GridSpec(x0=0.0, y0=2.0, dx=0.5, dy=0.5, nx=6, ny=4)
