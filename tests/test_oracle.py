"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry_points
from checks import catalog

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, database, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    expected = database.sql(entry_points.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    wanted = [tuple(r[i] for i in at) for r in expected.fetchall()]
    assert len(rows) == len(wanted) > 0
    for got, want in zip(sorted(rows, key=_key), sorted(wanted, key=_key)):
        for a, b in zip(got, want):
            same = a == b or (
                isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-10)
            )
            assert same, (got, want)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert [r.design for r in entry_points.entry(spark).collect()]
