import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestack.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)


@pytest.fixture
def clash():
    """Adds columns whose names an operator might use itself, or that differ in case only."""
    from pyspark.sql import functions as F

    def add(df, *names):
        for n in names:
            df = df.withColumn(n, F.lit("x"))
        twice = df.select("*", *(F.lit("y").alias(c.upper()) for c in df.columns[:2] if c.upper() != c))
        return twice

    return add
