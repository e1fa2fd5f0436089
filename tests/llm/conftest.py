import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rows import ODD, frame  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF
