"""Every registered query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from oracle import connect, differences
from tableview.plans import ALL

FOLDER = os.environ.get("TABLEVIEW_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

# Queries of subpackages that nothing here needs are tested with those.
RUNS = {name: run for name, run in registered.queries().items() if name in ALL}
SQLS = {name: sql for name, sql in registered.oracle_sql().items() if name in ALL}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    assert differences(spark, duck, FOLDER, RUNS[name], SQLS[name]) == ""


def test_every_query_has_sql():
    assert set(SQLS) == set(RUNS)


def test_entry(spark):
    page = registered.entry(spark)
    assert page.columns == ["_view_row", "o_orderkey", "o_totalprice"]
    assert page.count() > 0
