import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bayeslake.session import get_spark
    s = get_spark("local[*]", 8)
    yield s
    s.stop()


H1_ROWS = [(0, 0, 1.0), (0, 0, 2.0), (0, 1, 4.0), (0, 1, 6.0),
           (1, 0, 1.5), (1, 1, 5.0), (1, 1, 7.0), (1, 1, 9.0)]
H2_ROWS = [(0, 1.0, 2.0), (0, 2.0, 3.0), (0, 3.0, 5.0), (1, 4.0, 4.0), (1, 5.0, 7.0), (1, 6.0, 6.0)]


@pytest.fixture
def h1(spark):
    return spark.createDataFrame(H1_ROWS, "d int, label int, c double")


@pytest.fixture
def h2(spark):
    return spark.createDataFrame(H2_ROWS, "k int, x double, y double")
