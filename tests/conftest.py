from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

for folder in ("", "tests"):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tableview-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def saved(spark, tmp_path):
    """Write rows as one Parquet file, in order, and return its folder."""

    def save(rows, schema, name="table", files=1):
        path = str(tmp_path / f"{name}.parquet")
        if not rows:
            spark.createDataFrame([], schema).write.parquet(path)
            return path
        step = -(-len(rows) // files)
        for begin in range(0, len(rows), step):
            part = spark.createDataFrame(rows[begin : begin + step], schema)
            part.coalesce(1).write.mode("append").parquet(f"{path}/part={begin}" if files > 1 else path)
        return path

    return save


PARCELS_SCHEMA = "parcel string, weight double, hub string, pieces int, left_on date, due_on date, note string"


def _may(day):
    return dt.date(2021, 5, day)


PARCELS = [
    ("north/17", 12.5, "Oslo", 3, _may(3), _may(9), "fragile"),
    ("north/18", 0.75, "Bergen", 1, _may(4), _may(4), None),
    ("south/02", 140.0, "Oslo", 8, _may(2), _may(1), "FRAGILE, wet"),
    ("south/03", None, "oslo harbour", 2, None, _may(6), ""),
    ("east/90", 33.25, None, 1, _may(7), _may(20), "left at door"),
    ("east/91", 33.25, "Turku", 5, _may(8), None, "100% recycled"),
    ("west/40", 61.0, "Oslo", 2, _may(5), _may(5), 'say "hi"'),
]


@pytest.fixture
def parcels(spark, saved):
    from tableview import View, open_table

    return View.of(open_table(spark, saved(PARCELS, PARCELS_SCHEMA, "parcels")))
