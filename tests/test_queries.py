"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")

QUERIES = {k: v for k, v in entry.queries().items() if k in entry.catalogue.QUERIES}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}
MODELS = {"rf_predictions", "gbt_predictions", "softmax_predictions", "importance_top20", "cross_validation"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def rows(pdf):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, float) else str(v)

    ordered = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in ordered.where(ordered.notna(), None).values.tolist())


def test_every_query_has_a_counterpart():
    assert set(QUERIES) - set(ORACLE) == MODELS and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0 and rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
