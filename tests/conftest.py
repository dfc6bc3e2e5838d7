import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate an expression over rows of text values, in order."""
    from pyspark.sql import functions as F

    def run(expression, rows, names=("a", "b", "c")):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = "i int, " + ", ".join(f"{n} string" for n in names[: len(rows[0])])
        data = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = data.select("i", expression.alias("out")).orderBy("i").collect()
        return [r.out for r in out]

    run.F = F
    return run
