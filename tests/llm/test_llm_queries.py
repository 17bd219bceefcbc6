from __future__ import annotations

import pytest

import __spark_entry__ as registered
from oracle import connect, differences
from tableview.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, name):
    assert differences(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name]) == ""


def test_one_query_for_each_operator():
    names = [name.split("_")[0] for name in QUERIES]
    assert sorted(names) == sorted(f"op{number}" for number in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())
