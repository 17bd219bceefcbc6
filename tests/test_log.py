"""The condition log: consecutive repeats, retention, listing, deleting."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tableview import ConditionError, ConditionLog, TableViewError, var
from tableview.operators.log import SCHEMA, cleaned, drop_consecutive, kept_entries, with_previous

WHEN = dt.datetime(2024, 5, 1, 12, 30, 45, 999, tzinfo=dt.UTC)


@pytest.fixture
def log(spark, tmp_path):
    return ConditionLog(spark, str(tmp_path / "log"))


def test_consecutive_repeat_is_skipped(log):
    assert log.add("/data/rivers", 'gauge = "up"', WHEN) == 1
    assert log.add("/data/rivers", '  gauge = "up"\n') is None
    assert log.add("/data/rivers", " \t ") is None
    rows = [tuple(row) for row in log.list().collect()]
    assert rows == [(1, "/data/rivers", "rivers", 'gauge = "up"', "2024-05-01T12:30:45+00:00")]


def test_repeat_is_judged_by_the_newest_entry_of_all(log):
    assert log.add("/data/a", "X = 1") == 1
    assert log.add("/data/b", "X = 1") == 2
    assert log.add("/data/a", "X = 1") == 3
    assert [row.id for row in log.list().collect()] == [3, 2, 1]
    assert [row.id for row in log.list("/data/a").collect()] == [3, 1]


def test_delete_and_clear(log):
    for path, text in [("/a", "1"), ("/b", "2"), ("/a", "3")]:
        log.add(path, text)
    log.delete(2)
    assert [row.id for row in log.list().collect()] == [3, 1]
    log.clear("/a")
    assert log.list().count() == 0
    log.add("/b", "4")
    log.clear()
    assert log.list().count() == 0


def test_retention(spark, tmp_path):
    log = ConditionLog(spark, str(tmp_path / "short"), entries=3)
    assert kept_entries(3) == 10 and kept_entries() == 500 and kept_entries(10**6) == 10_000
    batch = spark.range(1, 31).select(
        "id",
        F.lit("/a").alias("dataset_path"),
        F.lit("a").alias("dataset_name"),
        F.concat(F.lit(" X = "), F.expr("id div 2")).alias("where_text"),
        F.lit("2024-01-01T00:00:00+00:00").alias("executed_at"),
    )
    log.add_all(batch)
    kept = [(row.id, row.where_text) for row in log.list().collect()]
    assert kept == [(i, f"X = {i // 2}") for i in [30, *range(28, 10, -2)]]
    assert log.add("/a", "X = 15") is None
    assert log.add("/a", "X = 14") == 31
    assert log.list().count() == 10


def test_bulk_append_compares_with_the_newest_entry(spark, log):
    log.add("/a", "X = 1")
    columns = "id bigint, dataset_path string, dataset_name string, where_text string, executed_at string"
    batch = spark.createDataFrame(
        [(2, "/a", "a", "X = 1", ""), (3, "/b", "b", "X = 1", ""), (4, "/b", "b", "X = 1 ", "")],
        columns,
    )
    log.add_all(batch)
    assert [row.id for row in log.list().collect()] == [3, 1]


def _python_previous(rows, within):
    last, found = {}, {}
    for id, key, text in sorted(rows, key=lambda row: row[0]):
        group = key if within else None
        found[id] = last.get(group)
        last[group] = (key, text)
    return found


@pytest.mark.parametrize("within", [[], ["key"]])
@pytest.mark.parametrize("ids", ["dense", "sparse", "clustered", "negative"])
@pytest.mark.parametrize("per_group", [20, 10**6])
def test_previous_row(spark, within, ids, per_group):
    rng = random.Random(11)
    pool = {
        "dense": range(400),
        "sparse": rng.sample(range(10**9), 400),
        "clustered": [*range(200), *range(10**6, 10**6 + 200)],
        "negative": rng.sample(range(-5_000, 5_000), 400),
    }[ids]
    # One key holds most rows; a missing key and missing texts count as values.
    rows = [
        (id, rng.choice(["hot"] * 5 + ["cold", None]), rng.choice(["x", "y", None])) for id in pool
    ]
    frame = spark.createDataFrame(rows, "id bigint, key string, text string").repartition(5)
    found = with_previous(frame, "id", ["key", "text"], within, per_group)
    assert found.columns == ["id", "key", "text", "_previous"]
    result = {row.id: row._previous and tuple(row._previous) for row in found.collect()}
    assert result == _python_previous(rows, within)
    kept = drop_consecutive(frame, "id", ["key", "text"], within, ids_per_group=per_group)
    previous = _python_previous(rows, within)
    wanted = {id for id, key, text in rows if previous[id] != (key, text)}
    assert {row.id for row in kept.collect()} == wanted


def test_no_group_grows_with_a_hot_key(spark):
    """Every window over the rows is partitioned by a group of ids as well as the key."""
    frame = spark.range(100_000).select("id", F.lit("hot").alias("key"), (F.col("id") % 3).alias("v"))
    kept = drop_consecutive(frame, "id", ["v"], within=["key"], ids_per_group=1_000)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert any("_group_1000" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)
    assert kept.count() == 100_000


def test_empty_log_frame(spark):
    empty = spark.createDataFrame([], "id bigint, text string")
    assert drop_consecutive(empty, "id", ["text"]).count() == 0


def test_blanks_are_those_python_strips(spark):
    rows = [(i, f"{chr(i)}x{chr(i)}") for i in range(1, 0x3100) if chr(i).isspace()]
    frame = spark.createDataFrame(rows, "id int, where_text string")
    assert {row.where_text for row in cleaned(frame).collect()} == {"x"}
    blank = spark.createDataFrame([(1, " \t　"), (2, None)], "id int, where_text string")
    assert cleaned(blank).count() == 0


def test_ids_are_never_used_again(log):
    assert [log.add("/a", text) for text in "12"] == [1, 2]
    log.delete(2)
    assert log.add("/a", "3") == 3
    log.clear()
    assert log.add("/a", "4") == 4


def test_a_batch_with_used_or_repeated_ids_is_refused(spark, log):
    log.add("/a", "1")
    schema = log.read().schema
    for ids in ((1, 2), (5, 5), (None, 7)):
        rows = [(number, "/a", "a", f"X = {at}", "") for at, number in enumerate(ids)]
        with pytest.raises(TableViewError, match="unique and above 1"):
            log.add_all(spark.createDataFrame(rows, schema))
    log.add_all(spark.createDataFrame([(9, "/a", "a", "X = 9", "")], schema))
    assert log.add("/a", "10") == 10


def test_a_logged_condition_is_applied_again(log, parcels):
    light = (var("weight") < 40) & ~var("HUB").prefix("=", "O")
    number = log.add("/data/parcels", light, WHEN)
    assert log.add("/data/parcels", light.text) is None
    assert log.list().columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    typed = log.add("/data/parcels", "weight < 40")
    again = log.reapply(number, parcels)
    assert [row.parcel for row in again.page().collect()] == ["north/18", "east/90", "east/91"]
    with pytest.raises(TableViewError, match="no condition"):
        log.condition(typed)
    with pytest.raises(ConditionError):
        log.reapply(log.add("/data/other", var("nowhere") == 1), parcels)
    # What is kept of the log keeps its conditions.
    log.delete(typed)
    assert log.condition(number).text == light.text
