"""What keeps work in bounds on big tables: skip index, sorts in two passes, top-k in levels."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tableview import Found, View, find, open_table, snapshot, storage, var
from tableview.sources import ordered_files
from tableview.sources.ordered_files import SORTED_AT_ONCE, scan_tasks, sorted_parts, thinned

WORDS = ["granite", "slate", "ÄRGER", "chalk", "mud"]


@pytest.fixture(scope="module")
def fifty(spark, tmp_path_factory):
    """50 files of 20 rows; a rare word stands in two of them, a rare number in one."""
    path = str(tmp_path_factory.mktemp("fifty") / "stones.parquet")
    rng = random.Random(8)
    rows = [(at, rng.choice(WORDS), float(at), rng.randrange(3)) for at in range(1_000)]
    rows[437] = (437, "Quartz!", 437.0, 1)
    rows[861] = (861, "rose quartz", 9.125e-7, 2)
    rows[333] = (333, "¿?", 333.0, None)
    frame = spark.createDataFrame(rows, "k bigint, stone string, weight double, n int")
    frame.coalesce(1).write.option("maxRecordsPerFile", 20).parquet(path)
    return open_table(spark, path)


def files_read(frame):
    """Files that the scans of a frame opened."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if plan.nodeName() == "ResultQueryStage":
        plan = plan.plan()
    leaves = plan.collectLeaves()
    metrics = [leaves.apply(at).metrics() for at in range(leaves.size())]
    return sum(found.apply("numFiles").value() for found in metrics if found.contains("numFiles"))


def views(table):
    shown = View.of(table).select("stone", "weight", "k")
    return [
        shown,
        shown.where(var("n") < 2),
        shown.sort_by("weight", ascending=False),
        View.of(snapshot(table, rows_per_file=20)).select("stone", "weight"),
    ]


@pytest.mark.parametrize("which", range(4))
def test_a_skip_index_changes_no_result(fifty, which):
    plain, indexed = views(fifty)[which], views(fifty)[which].index_text()
    # One view is searched for all texts, the others for three of them.
    texts = ["QUARTZ", "¿", "e-07", "tz", "ärger", "437.0", "nowhere"]
    for at, text in enumerate(texts if which == 0 else texts[:3]):
        start, forward = ((500, True), (500, False), (None, False))[at % 3]
        wanted = find(plain, text, start, forward=forward)
        assert find(indexed, text, start, forward=forward) == wanted, (text, start)
        wanted = sorted(map(tuple, plain.matching(text).collect()), key=str)
        assert sorted(map(tuple, indexed.matching(text).collect()), key=str) == wanted, text
    indexed.release()
    plain.release()


def test_only_files_that_may_show_the_text_are_read(fifty):
    shown = View.of(fifty).select("stone", "weight")
    assert files_read(shown.matching("quartz")) == 50
    indexed = shown.index_text()
    index = indexed.index()
    for text, files in (("quartz", 2), ("¿", 1), ("tz", 2), ("9.125", 1), ("no such text", 0)):
        assert len(index.files_with(text)) == files, text
        if files:
            assert files_read(indexed.matching(text)) == files
    assert find(indexed, "rose") == Found(861, "stone")
    assert not index.holds(0, 420, index.files_with("quartz"))
    # Columns the skip index does not cover are searched without it.
    assert indexed.show("n").index().files_with("quartz") is None
    assert len(indexed.show("n").index_text().index().files_with("quartz")) == 2
    indexed.release()


def test_an_index_made_anew_has_no_old_skip_index(fifty):
    narrow = View.of(fifty).select("stone").where(var("n") < 3).index_text()
    wide = narrow.show("k")
    assert find(wide, "861") == find(View.of(fifty).select("stone", "k").where(var("n") < 3), "861")
    narrow.release()


# ---- sorts ------------------------------------------------------------------------------


def exchanges(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return [int(count) for count in re.findall(r"(?:range|hash)partitioning\(.*?, (\d+)\)", text)]


def test_no_sort_of_a_huge_table_has_one_huge_shuffle(spark, fifty, monkeypatch):
    rows = fifty.with_source_row
    asked = []
    deal = type(rows).repartitionByRange

    def spied(frame, count, *columns):
        asked.append(count)
        return deal(frame, min(count, 4), *columns)

    monkeypatch.setattr(type(rows), "repartitionByRange", spied)
    order = [F.col("stone").asc_nulls_first(), F.col("_source_row").asc()]
    parts = [part.collect() for part in sorted_parts(rows, order, 100 * 1024**4)]
    assert asked[0] == 453 and max(asked) <= SORTED_AT_ONCE
    found = [(row.stone, row._source_row) for part in parts for row in part]
    assert found == sorted(found) and len(found) == 1_000


def test_two_passes_give_the_same_index_and_export(spark, fifty, monkeypatch, tmp_path):
    from tableview import export_csv

    view = View.of(fifty).select("stone", "weight").sort_by("stone", ascending=False)
    wanted = [tuple(row) for row in view.view_rows().orderBy("_view_row").collect()]
    before = len(storage.list_files(spark, storage.work_dir(spark)))
    monkeypatch.setattr(ordered_files, "SORTED_AT_ONCE", 3)
    monkeypatch.setattr(ordered_files, "partition_count", lambda spark, size: 9)
    again = View.of(fifty).select("stone", "weight").sort_by("stone", ascending=False)
    assert len(list(again.ordered_parts())) == 3
    assert [tuple(row) for row in again.view_rows().orderBy("_view_row").collect()] == wanted
    again.release()
    done = export_csv(again, str(tmp_path / "stones.csv"), single_file=True)
    lines = (tmp_path / "stones.csv").read_text("utf-8-sig").splitlines()
    assert done.rows == 1_000 and len(lines) == 1_001
    assert [line.split(",")[0] for line in lines[1:]] == [row[2] for row in wanted]
    # What was dealt is gone.
    assert len(storage.list_files(spark, storage.work_dir(spark))) == before


# ---- top-k ------------------------------------------------------------------------------


def test_a_wide_top_k_is_thinned_in_levels(spark, monkeypatch):
    monkeypatch.setattr(ordered_files, "TOP_CANDIDATES", 40)
    frame = spark.range(10_000, numPartitions=64).select((F.col("id") * 7_919 % 10_007).alias("k"))
    order = [F.col("k").asc()]
    few = thinned(frame, order, 10, 64)
    # 64 tasks hand their 10 rows each to 16, those to 4; the last one gets 40 at most.
    assert few.rdd.getNumPartitions() == 4
    assert few.count() == 160
    found = [row.k for row in few.orderBy(*order).limit(10).collect()]
    assert found == sorted(row.k for row in frame.collect())[:10]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan


def test_a_small_top_k_is_one_step(spark, fifty):
    plan = View.of(fifty).sort_by("stone").page(0, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Coalesce" not in plan
    assert "RoundRobin" not in plan and "SinglePartition" not in plan


def test_pages_are_the_same_in_levels(fifty, monkeypatch):
    view = View.of(fifty).where(var("n") < 2).sort_by("weight")
    wanted = [tuple(row) for row in view.page(30, 60).collect()]
    monkeypatch.setattr(ordered_files, "TOP_CANDIDATES", 200)
    monkeypatch.setattr("tableview.operators.view.scan_tasks", lambda *_: 50)
    assert [tuple(row) for row in view.page(30, 60).collect()] == wanted


def test_scan_tasks_follow_the_splits(spark):
    assert scan_tasks(spark, 0) == 1
    assert scan_tasks(spark, 100 * 1024**4, 200_000) == 819_200 + 6_250
