import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def days(spark):
    """Daily (date, sales) rows from a start date and a list of values."""
    import datetime as dt

    def build(values, start="2024-01-01", **extra):
        first = dt.date.fromisoformat(start)
        rows = [(first + dt.timedelta(i), None if v is None else float(v), *extra.values()) for i, v in enumerate(values)]
        names = "".join(f", {k} string" for k in extra)
        return spark.createDataFrame(rows, f"date date, sales double{names}")

    return build


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
