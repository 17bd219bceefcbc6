"""Progressive loading, its gate, and re-binding a view to a new version."""

from __future__ import annotations

from dataclasses import replace

import pytest

from tableview import (
    IncompleteTableError,
    TableViewError,
    View,
    export_csv,
    find,
    ingest,
    open_table,
    rebind,
    snapshot,
    storage,
    var,
)
from tableview.sources.table import table_of

ROWS = [(f"101-{i:03d}", float(20 + i % 50)) for i in range(1, 101)]
SCHEMA = "station string, reading double"
DESCRIBED = {"reading": {"label": "Age", "length": 8, "format": "8."}}


@pytest.fixture(params=["source files", "snapshot"])
def source(request, spark, saved):
    if request.param == "source files":
        return open_table(spark, saved(ROWS, SCHEMA, files=4), described=DESCRIBED)
    whole = open_table(spark, saved(ROWS, SCHEMA), described=DESCRIBED)
    return snapshot(whole, rows_per_file=25)


def test_loads_in_batches(source):
    load = ingest(source, files_per_batch=1)
    table = load.wait()
    assert load.batches() == [25, 25, 25, 25]
    status = load.status()
    assert (status.cached_rows, status.total_rows, status.complete) == (100, 100, True)
    assert tuple(load.status_frame().first()) == (100, 100, True)
    rows = table.with_source_row.orderBy("_source_row").collect()
    assert [(row.station, row.reading) for row in rows] == ROWS
    assert [row._source_row for row in rows] == list(range(1, 101))
    assert table.catalog.exact("reading").label == "Age"
    view = View.of(table).where(var("reading") >= 60).sort_by("reading", ascending=False)
    assert view.count() == sum(age >= 60 for _, age in ROWS)
    assert view.page(0, 1).first().station == "101-049"


def test_bytes_bound_batches(spark, saved):
    source = open_table(spark, saved(ROWS, SCHEMA, files=4))
    load = ingest(source, bytes_per_batch="1")
    load.wait()
    assert len(load.batches()) == 4


def test_single_file_source(spark, saved, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "x"))
    (path,) = [str(p) for p in (tmp_path / "x").iterdir() if p.name.endswith(".parquet")]
    table = ingest(open_table(spark, path)).wait()
    assert table.with_source_row.count() == 100


def test_a_restarted_load_goes_on_where_it_stopped(source):
    first = ingest(source)
    first.wait()
    again = ingest(source, folder=first.folder)
    table = again.wait()
    assert again.batches() == []
    assert table.status().cached_rows == 100


def partial(source):
    return table_of(
        source.spark,
        source.path,
        snapshot(source).rows.filter("_source_row <= 30"),
        complete=False,
        expected_rows=100,
    )


def test_only_browsing_while_loading(spark, saved, tmp_path):
    table = partial(open_table(spark, saved(ROWS, SCHEMA)))
    view = View.of(table)
    status = table.status()
    assert (status.cached_rows, status.total_rows, status.complete) == (30, 100, False)
    assert view.select("reading").page(20, 50).count() == 10
    for action in (
        lambda: view.where(var("reading") > 1),
        lambda: view.where(None),
        lambda: view.sort_by("reading"),
        lambda: find(view, "101"),
        lambda: view.row(5),
        lambda: export_csv(view, str(tmp_path / "x.csv")),
        lambda: snapshot(table),
    ):
        with pytest.raises(IncompleteTableError):
            action()


def test_failed_load_is_not_complete(spark, saved):
    from pyspark.sql import functions as F

    path = saved(ROWS, SCHEMA)
    broken = {"reading": F.raise_error(F.lit("unreadable")).cast("double")}
    load = ingest(open_table(spark, path, derive=broken))
    with pytest.raises(Exception, match="unreadable"):
        load.wait()
    assert not load.finished
    assert load.status().cached_rows == 0 and load.status().total_rows == 100
    assert not load.table().complete


def test_rebind_keeps_what_fits(spark, saved):
    old = (
        View.of(open_table(spark, saved([("a", 1.0, 5), ("b", 2.0, 6)], "s string, x double, n int")))
        .select("n", "x", "s")
        .where(var("x") > 1)
        .sort_by("x", ascending=False)
    )
    new = open_table(
        spark, saved([(3.0, "c"), (0.5, "d"), (9.0, "e")], "x double, s string", "new")
    )
    done = rebind(old, new)
    assert done.view.columns == ("x", "s")
    assert done.warning == "" and done.pending is None
    assert [(row.x, row.s) for row in done.view.page().collect()] == [(9.0, "e"), (3.0, "c")]
    assert [row.s for row in old.page().collect()] == ["b"]


def test_rebind_drops_what_no_longer_fits(spark, saved):
    old = (
        View.of(open_table(spark, saved([("a", 1.0)], "s string, x double")))
        .where(var("x") > 0)
        .sort_by("x")
    )
    text_now = open_table(spark, saved([("a", "1")], "s string, x string", "retyped"))
    done = rebind(old, text_now)
    assert "character" in done.warning
    assert done.view.condition is None and done.view.sort.variable == "x"
    gone = open_table(spark, saved([("a",)], "s string", "gone"))
    done = rebind(old, gone)
    assert "has no variable" in done.warning
    assert done.view.columns == ("s",) and done.view.sort is None


def test_rebind_while_loading_waits_with_the_condition(spark, saved):
    whole = open_table(spark, saved(ROWS, SCHEMA))
    old = View.of(whole).where(var("reading") > 60).sort_by("reading")
    done = rebind(old, partial(whole))
    assert done.view.sort is None and done.view.condition is None
    assert done.pending is old.condition
    assert done.view.page().count() == 30
    with pytest.raises(IncompleteTableError):
        done.resume()
    finished = rebind(old, whole)
    assert finished.resume() is finished
    assert finished.view.count() == old.count()


def test_failed_reload_keeps_the_old_view(spark, saved, tmp_path):
    view = View.of(open_table(spark, saved(ROWS, SCHEMA)))
    with pytest.raises(Exception):
        rebind(view, open_table(spark, str(tmp_path / "missing.parquet")))
    assert view.count() == 100
    assert storage.exists(spark, view.table.path)


def test_a_stopped_load_is_not_complete_and_shows_what_it_has(spark, saved):
    """Files whose times run against the order of their names arrive last name first."""
    import os

    path = saved(ROWS, SCHEMA, files=4)
    files = sorted(os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    for place, file in enumerate(files):
        os.utime(file, (2e9 - place * 10, 2e9 - place * 10))
    source = open_table(spark, path)
    load = ingest(source, files_per_batch=1)
    load.wait()
    first = load.batches()
    assert first == [25, 25, 25, 25] and load.finished
    stopped = replace(load, total_hint=400)
    assert not stopped.finished
    assert tuple(stopped.status_frame().first()) == (100, 400, False)
    view = View.of(stopped.table())
    pages = [view.page(at, 50).collect() for at in (0, 50)]
    assert [row._view_row for page in pages for row in page] == list(range(100))
    assert {row.station for page in pages for row in page} == {name for name, _ in ROWS}
    load.release()
    assert not storage.exists(spark, load.folder)


def test_reserved_names_and_release(spark, saved):
    path = saved([(0, "a"), (10, "b")], "_source_row int, t string")
    with pytest.raises(TableViewError, match="_source_row"):
        open_table(spark, path)
    table = snapshot(open_table(spark, saved(ROWS, SCHEMA, "plain")))
    assert open_table(spark, table.path).with_source_row.count() == 100
    table.release()
    assert not storage.exists(spark, table.path)


def test_a_larger_table_loads_in_as_many_batches(spark, saved, tmp_path, monkeypatch):
    from tableview.plans import tables

    monkeypatch.setattr(tables, "LOAD_BATCHES", 8, raising=False)
    saved([(at, at % 7) for at in range(200)], "event_id long, kind long", name="events")
    load = tables.loaded_events(spark, str(tmp_path), 2)
    assert tuple(load.status_frame().first()) == (200, 200, True)
    assert 8 <= len(load.batches()) <= 16
    few = tables.loaded_events(spark, str(tmp_path), 50)
    assert few.batches() == [50] * 4
    rows = load.table().with_source_row.orderBy("_source_row").collect()
    assert [(row._source_row, row.event_id) for row in rows] == [(at + 1, at) for at in range(200)]
