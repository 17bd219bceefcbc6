"""The plans behind the operators: what reaches the scan, what is shuffled, what is not."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tableview import View, missing, open_table, snapshot, var


@pytest.fixture
def view(spark, saved):
    rows = [(i, f"name {i}", float(i), i % 7) for i in range(2_000)]
    return View.of(open_table(spark, saved(rows, "k bigint, s string, x double, n int")))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def pushed(frame):
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(frame)).group(1)


def read_columns(frame):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(frame)).group(1)
    return {part.split(":")[0] for part in schema.split(",")} - {"_tmp_metadata_row_index"}


@pytest.mark.parametrize(
    "build, wanted",
    [
        (lambda: var("x") >= 100, "GreaterThanOrEqual(x,100.0)"),
        (lambda: ~(var("x") >= 100), "LessThan(x,100.0)"),
        (lambda: var("x").between(1, 2), "GreaterThanOrEqual(x,1.0), LessThanOrEqual(x,2.0)"),
        (lambda: var("k") == 5, "EqualTo(k,5)"),
        (lambda: var("k") >= 5.0, "GreaterThanOrEqual(k,5)"),
        (lambda: var("k").is_in(5, 6), "In(k, [5,6])"),
        (lambda: var("s").starts_with("na"), "StringStartsWith(s,na)"),
        (lambda: var("s").contains("am"), "StringContains(s,am)"),
        (lambda: var("s").like("na%"), "StringStartsWith(s,na)"),
        (lambda: ~missing("s"), "Not(EqualTo(s,))"),
        (lambda: ~((var("k") < 5) | (var("x") > 7)), "GreaterThanOrEqual(k,5)"),
        (lambda: var("s").prefix("=", "na"), "StringStartsWith(s,na)"),
        (lambda: var("s").prefix(">=", "na"), "GreaterThanOrEqual(s,na)"),
        (lambda: var("s").prefix(">", "na"), "GreaterThanOrEqual(s,nb)"),
        (lambda: var("s").prefix("<", "na"), "Or(IsNull(s),LessThan(s,na))"),
        (lambda: var("s").prefix("<=", "na"), "Or(IsNull(s),LessThan(s,nb))"),
        (lambda: var("s").prefix("!=", "na"), "LessThan(s,na)),And(IsNotNull(s),GreaterThanOrEqual(s,nb)))"),
        (lambda: ~var("s").prefix("<=", "na"), "GreaterThanOrEqual(s,nb)"),
    ],
)
def test_conditions_reach_the_scan(view, build, wanted):
    assert wanted in pushed(view.select("k").where(build()).rows())


def test_only_needed_columns_are_read(view):
    shown = view.select("k").where(var("n") == 3)
    assert read_columns(shown.rows()) == {"k", "n"}
    assert read_columns(shown.sort_by("x").page()) == {"k", "n", "x"}


def test_counting_reads_just_the_condition(view):
    frame = view._kept(view.table.unnumbered)
    assert "ReadSchema: struct<>" in plan(frame.agg(F.count(F.lit(1))))
    filtered = view.where(var("n") == 3)
    kept = filtered._kept(filtered.table.unnumbered).agg(F.count(F.lit(1)))
    assert read_columns(kept) == {"n"}


def test_a_page_near_the_top_is_a_top_k(view):
    text = plan(view.sort_by("x").page(100, 50))
    assert "TakeOrderedAndProject" in text
    assert "Exchange" not in text


def test_numbering_needs_no_shuffle(view, spark, saved):
    rows = [(i,) for i in range(100)]
    many = open_table(spark, saved(rows, "k int", "many", files=4))
    for frame in (view.view_rows(), many.with_source_row):
        assert "Exchange hashpartitioning" not in plan(frame)
        assert "Exchange rangepartitioning" not in plan(frame)
        assert "SinglePartition" not in plan(frame)


def test_sorting_has_one_range_shuffle_and_no_global_window(view):
    text = plan(view.sort_by("n").ordered())
    assert text.count("rangepartitioning") == 1
    assert "SinglePartition" not in text and "Window" not in text
    # The source row is part of the range, so one sort value can span partitions.
    assert re.search(r"rangepartitioning\(n#\d+ ASC NULLS FIRST, _source_row", text)


def test_numbered_rows_of_an_index_need_no_window(view):
    text = plan(view.sort_by("n").view_rows())
    assert "Window" not in text and "SinglePartition" not in text


def test_stored_row_numbers_are_pushed(view):
    frozen = snapshot(view.table)
    assert "GreaterThan(_source_row,10), LessThanOrEqual(_source_row,20)" in pushed(
        frozen.source_range(10, 20)
    )


def test_big_tables_get_more_sort_partitions(spark, view):
    from tableview.sources.ordered_files import partition_count, sorted_rows

    assert partition_count(spark, 1) == 8
    assert partition_count(spark, 100 * 1024**4) == 204_800
    frame = sorted_rows(view.rows(), [F.col("k").asc()], 20 * 512 * 1024**2)
    assert "rangepartitioning(k#" in plan(frame) and ", 20)" in plan(frame)
    assert [row.k for row in frame.collect()] == list(range(2_000))
