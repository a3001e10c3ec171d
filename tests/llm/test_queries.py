"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from biospark.llm import queries
from tests.conftest import SMALL
from tests.test_queries import rows

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SMALL):
        duck.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    got, expected = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0 and rows(got) == rows(expected)
