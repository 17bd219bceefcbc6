"""Opening, numbering, cleaning, describing and freezing tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tableview import TableViewError, View, open_table, snapshot, storage, var
from tableview.sources import ordered_files
from tableview.sources.ordered_files import OrderedFiles, natural_order
from tableview.sources.table import table_of

SHELVES = [("A/1", 80.5), ("A/2", 12.0), ("B/1", 99.0), ("B/2", 45.0)]
SHELF_SCHEMA = "shelf string, depth double"
DESCRIBED = {
    "shelf": {"label": "Shelf mark", "length": 6, "format": "$6."},
    "depth": {"label": "Depth in cm", "length": 8, "format": "6.1"},
}


def numbers(frame, column="k"):
    return [(row._source_row, row[column]) for row in frame.orderBy("_source_row").collect()]


def test_open_and_describe(spark, saved):
    table = open_table(spark, saved(SHELVES, SHELF_SCHEMA), described=DESCRIBED)
    assert [tuple(row) for row in table.contents().orderBy("position").collect()] == [
        (1, "shelf", "Shelf mark", "character", 6, "$6."),
        (2, "depth", "Depth in cm", "numeric", 8, "6.1"),
    ]
    assert [row.name for row in table.contents(" MARK char").collect()] == ["shelf"]
    assert [row.name for row in table.contents("numeric 8").collect()] == ["depth"]
    assert table.contents("$6. x").count() == 0
    assert table.contents("  ").count() == 2
    assert table.status().cached_rows == 4
    # The description is stored with a snapshot.
    frozen = snapshot(table)
    assert frozen.rows.schema["depth"].metadata == DESCRIBED["depth"]
    assert open_table(spark, frozen.path).catalog.exact("shelf").label == "Shelf mark"


def test_lengths_are_measured_when_not_declared(spark, saved):
    table = open_table(spark, saved([("añb", 1, None), (None, 2, None)], "t string, i int, d date"))
    assert [(r.name, r.kind, r.length) for r in table.contents().collect()] == [
        ("t", "character", 3),
        ("i", "numeric", 4),
        ("d", "temporal", 4),
    ]


def test_no_variables(spark, saved):
    path = saved([(1,)], "a int")
    with pytest.raises(TableViewError):
        table_of(spark, path, spark.read.parquet(path).select())


def test_values_are_cleaned(spark, saved):
    rows = [
        (math.nan, b"ab\xff", [1, 2], True, math.inf),
        (math.inf, None, None, None, 1.5),
        (-math.inf, "é".encode(), [], False, None),
        (2.0, b"", [None], True, math.nan),
    ]
    table = open_table(spark, saved(rows, "x double, y binary, z array<int>, f boolean, g float"))
    cleaned = [tuple(row) for row in table.with_source_row.orderBy("_source_row").collect()]
    assert cleaned == [
        (1, None, "ab�", "[1, 2]", True, None),
        (2, None, None, None, None, 1.5),
        (3, None, "é", "[]", False, None),
        (4, 2.0, "", "[null]", True, None),
    ]
    view = View.of(table)
    assert view.where(var("y").contains("�")).count() == 1
    assert view.where(var("z") == "[1, 2]").count() == 1
    assert view.where(var("x").is_missing()).count() == 3
    lines = [row.line for row in view.csv_lines().orderBy("_view_row").collect()]
    assert lines[0] == ',ab�,"[1, 2]",1.0,'


@pytest.mark.parametrize("files", [1, 4])
def test_source_rows(spark, saved, files):
    path = saved([(i,) for i in range(100)], "k int", files=files)
    table = open_table(spark, path)
    assert numbers(table.with_source_row) == [(i + 1, i) for i in range(100)]
    assert numbers(table.source_range(20, 61)) == [(i + 1, i) for i in range(20, 61)]
    assert table.source_range(100, 200).count() == 0
    kept = table.numbered.filter("k % 7 = 3")
    assert numbers(kept) == [(i + 1, i) for i in range(100) if i % 7 == 3]


def test_source_rows_without_broadcast(spark, saved, monkeypatch):
    path = saved([(i,) for i in range(100)], "k int", files=4)
    monkeypatch.setattr(ordered_files, "BROADCAST_RUNS", 1)
    monkeypatch.setattr(ordered_files, "SLICE_ROWS", 7)
    frame = open_table(spark, path).with_source_row
    assert numbers(frame) == [(i + 1, i) for i in range(100)]
    assert "hashpartitioning" not in frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordered_files, "MOST_RUNS", 1)
    frame = open_table(spark, path).with_source_row
    assert numbers(frame) == [(i + 1, i) for i in range(100)]
    assert "Broadcast" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_needed_files_are_read(spark, saved):
    path = saved([(i,) for i in range(100)], "k int", files=4)
    table = open_table(spark, path)
    assert len(table.files.runs) == 4
    part = table.source_range(30, 40)
    assert [row._source_row for row in part.collect()] == list(range(31, 41))
    read = part.select(F.input_file_name()).distinct().collect()
    assert len(read) == 1
    covering = table.files._covering(30, 40)
    assert [(run.first, run.rows) for run in covering] == [(25, 25)]


def test_file_order_counts_numbers():
    names = ["part-100000-x.parquet", "part-99999-x.parquet", "part-00002-x-c010", "part-00002-x-c9"]
    assert sorted(names, key=natural_order) == [
        "part-00002-x-c9",
        "part-00002-x-c010",
        "part-99999-x.parquet",
        "part-100000-x.parquet",
    ]


@pytest.mark.parametrize("format, options", [("csv", {"header": "true"}), ("orc", {}), ("json", {})])
def test_other_formats_keep_their_order(spark, tmp_path, format, options):
    path = str(tmp_path / "other")
    for begin in (0, 40, 80):
        part = spark.range(begin, begin + 40).select(
            F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")
        )
        target = f"{path}/{begin:03d}"
        part.coalesce(1).write.format(format).options(**options).save(target)
    table = open_table(
        spark, path + "/*", format=format, schema="k bigint, v string", options=options
    )
    assert table.catalog.names == ["k", "v"]
    assert numbers(table.with_source_row) == [(i + 1, i) for i in range(120)]
    assert numbers(table.source_range(35, 45)) == [(i + 1, i) for i in range(35, 45)]
    view = View.of(table).where(var("v").starts_with("v1")).sort_by("k", ascending=False)
    assert view.page(0, 1).first().k == 119


def test_csv_is_split_and_still_in_order(spark, tmp_path):
    path = str(tmp_path / "split.csv")
    spark.range(2_000).coalesce(1).write.csv(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        table = open_table(spark, path, format="csv", schema="k bigint")
        assert len(table.files.runs) > 5
        assert numbers(table.with_source_row) == [(i + 1, i) for i in range(2_000)]
        assert numbers(table.source_range(990, 1_010)) == [(i + 1, i) for i in range(990, 1_010)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_snapshot_outlives_its_source(spark, saved):
    path = saved(SHELVES, SHELF_SCHEMA)
    table = open_table(spark, path, described=DESCRIBED)
    frozen = snapshot(table)
    storage.delete(spark, path)
    view = View.of(frozen).where(var("depth") < 90)
    assert view.count() == 3
    assert [row.shelf for row in view.page().collect()] == ["A/1", "A/2", "B/2"]
    assert [row._source_row for row in frozen.source_range(1, 4).collect()] == [2, 3, 4]


def test_failed_snapshot_leaves_nothing(spark, saved):
    path = saved(SHELVES, SHELF_SCHEMA)
    broken = {"depth": F.raise_error(F.lit("broken source")).cast("double")}
    table = open_table(spark, path, derive=broken)
    before = len(storage.list_files(spark, storage.work_dir(spark)))
    with pytest.raises(Exception, match="broken source"):
        snapshot(table)
    assert len(storage.list_files(spark, storage.work_dir(spark))) == before


def test_empty_table(spark, saved):
    view = View.of(open_table(spark, saved([], "a string, b int")))
    assert view.count() == 0
    assert view.page().count() == 0
    assert view.sort_by("b").view_rows().count() == 0
    assert view.where(var("a") == "x").row(1).count() == 0
    assert OrderedFiles(spark, view.table.rows).total == 0


def test_many_tables_at_once(spark, saved):
    first = View.of(open_table(spark, saved(SHELVES, SHELF_SCHEMA, "one")))
    second = View.of(open_table(spark, saved([(1,)], "b int", "two")))
    assert (first.count(), second.count(), first.table.name, second.table.name) == (4, 1, "one", "two")


def test_work_dir_comes_from_the_session(spark):
    assert storage.work_dir(spark) == spark.conf.get("spark.checkpoint.dir") + "/tableview"
