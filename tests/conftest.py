import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from twinfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4, memory="4g", more={"spark.default.parallelism": "1"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a single text."""
    def value(make, text, *more):
        row = spark.createDataFrame([(text, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more))))
        return row.select(make(*[f"c{i}" for i in range(1 + len(more))]).alias("v")).first()["v"]
    return value
