from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from biospark.session import build_session  # noqa: E402

T0 = dt.datetime(2023, 1, 1)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.log.level": "ERROR"}
    )
    yield session
    session.stop()


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def seconds(ts: dt.datetime) -> float:
    return (ts - T0).total_seconds()


def samples(spark, rows, columns="subject string, seconds double, hr double"):
    """Rows (subject, seconds, ...) as a table with a timestamp column."""
    names = [c.split()[0] for c in columns.split(",")]
    data = [tuple(at(v) if n == "seconds" else v for n, v in zip(names, row)) for row in rows]
    return spark.createDataFrame(data, columns.replace("seconds double", "timestamp timestamp"))
