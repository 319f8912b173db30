import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scanweave.session import local_session
from scanweave.shipping import ship

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "scanweave-tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def values(spark):
    """Evaluates a Column function over rows of Python values."""

    def run(fn, rows, schema):
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
        out = df.select("i", fn(*[F.col(n) for n in names]).alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["i"])]

    return run
