import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logquarry.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
# Columns are built while tests are collected, which needs a session already.
SESSION = local_session(8, "logquarry-tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def column(spark):
    """Evaluate a column over a list of values."""

    def run(values, expr, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.out for r in rows.select("i", expr.alias("out")).orderBy("i").collect()]

    return run
