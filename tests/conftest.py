import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foliograph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture
def apply(spark):
    """Evaluate a column function over a list of values of column ``c``."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
        return [r.out for r in rows.select("i", fn(F.col("c")).alias("out")).orderBy("i").collect()]

    return run
