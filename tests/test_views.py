"""Columns, order, pages, counts and find, on golden rows and against plain Python."""

from __future__ import annotations

import random

import pytest

from tableview import (
    ColumnSelectionError,
    Found,
    View,
    find,
    find_frame,
    open_table,
    page_rows,
    page_start,
    var,
)
from tableview.operators import search
from tableview.operators import view as view_module


def rows_of(frame, *names):
    return [tuple(row[name] for name in names) for row in frame.collect()]


@pytest.fixture
def heavy(parcels):
    """The parcels of the big hubs and of some weight, the lightest first."""
    wanted = var("hub").is_in("Oslo", "Turku") & (var("weight") > 12)
    return parcels.where(wanted).select("pieces", "parcel", "weight").sort_by("weight")


def test_page_of_a_filtered_sorted_view(heavy):
    assert heavy.count() == 4
    page = heavy.page(1, 2)
    assert page.columns == ["_view_row", "pieces", "parcel", "weight"]
    assert rows_of(page, *page.columns) == [(1, 5, "east/91", 33.25), (2, 2, "west/40", 61.0)]


def test_equal_keys_keep_their_order(parcels):
    down = parcels.sort_by("weight", ascending=False)
    assert [row.parcel for row in down.page().collect()] == [
        "south/02", "west/40", "east/90", "east/91", "north/17", "north/18", "south/03",
    ]


def test_summary(heavy):
    assert rows_of(heavy.summary(), "filtered_rows", "total_rows", "visible_columns", "filtered") == [
        (4, 7, 3, True)
    ]
    assert heavy.where(None).summary().first().filtered is False


def test_find_in_a_view(heavy):
    assert find(heavy, "EAST") == Found(1, "parcel")
    assert find(heavy, "1", 1) == Found(2, "weight")
    assert find(heavy, "12.5") == Found(0, "weight")
    assert find(heavy, "north", 0) == Found(0, "parcel")
    assert find(heavy, "door") is None
    assert find(heavy, "") is None
    assert find_frame(heavy, "").count() == 0
    assert find_frame(heavy, "no such").count() == 0


def test_column_order(parcels):
    view = parcels.select("note", "hub", "pieces")
    assert view.hide("hub").columns == ("note", "pieces")
    assert view.hide("note").show("weight", "note").columns == ("hub", "pieces", "weight", "note")
    assert view.show("pieces").columns == ("note", "hub", "pieces")
    nothing = parcels.toggle_all()
    assert nothing.columns == ()
    assert nothing.toggle_all().columns == parcels.columns
    assert view.toggle_all().columns == parcels.columns


def test_column_errors(parcels):
    with pytest.raises(ColumnSelectionError):
        parcels.select()
    with pytest.raises(ColumnSelectionError):
        parcels.select("HUB")
    with pytest.raises(ColumnSelectionError):
        parcels.sort_by("Weight")
    hidden = parcels.hide(*parcels.columns)
    for action in (hidden.page, hidden.rows, hidden.index, hidden.csv_lines):
        with pytest.raises(ColumnSelectionError):
            action()
    with pytest.raises(ColumnSelectionError):
        find(hidden, "x")
    assert hidden.count() == 7


def test_page_arithmetic():
    assert page_start(75_123) == 75_000
    assert page_start(499) == 0
    assert (page_rows(), page_rows(1), page_rows(10**6)) == (500, 50, 5_000)


def test_views_do_not_change(parcels):
    filtered = parcels.where(var("pieces") >= 3)
    assert parcels.count() == 7 and filtered.count() == 3
    assert filtered.where(None).count() == 7
    assert filtered.sort_by("hub").in_source_order().sort is None


def test_odd_column_names(spark, saved):
    path = saved([("x", 1.0), ("y", 2.0)], "`a.b` string, `c ``d` double")
    view = View.of(open_table(spark, path)).sort_by("c `d", ascending=False)
    assert rows_of(view.where(var("a.b") != "x").page(), "a.b") == [("y",)]
    assert [row.line for row in view.csv_lines().orderBy("_view_row").collect()] == ["y,2.0", "x,1.0"]
    assert find(view, "x") == Found(1, "a.b")


# ---- a bigger table, against Python ------------------------------------------------------

SCHEMA = "k int, s string, x double, t string"


def _random_rows(count):
    rng = random.Random(7)
    return [
        (
            i,
            rng.choice([None, "", "a", "b", "ab", "Ab", "ba", "zz"]),
            rng.choice([None, float("nan"), 1.0, 2.0, 2.5, -1.0, 1e9]),
            "".join(rng.choice("abcxyz") for _ in range(4)),
        )
        for i in range(count)
    ]


ROWS = _random_rows(3_000)


def clean(x):
    return None if x is None or x != x else x


def expected(sort, ascending=True, keep=lambda row: True):
    rows = [(k, s, clean(x), t) for k, s, x, t in ROWS if keep((k, s, clean(x), t))]
    if sort is None:
        return rows
    place = {"k": 0, "s": 1, "x": 2, "t": 3}[sort]
    present = [row for row in rows if row[place] is not None]
    absent = [row for row in rows if row[place] is None]
    present.sort(key=lambda row: row[place], reverse=not ascending)
    if not ascending:  # equal keys stay in source order
        present.sort(key=lambda row: row[0])
        present.sort(key=lambda row: row[place], reverse=True)
    return absent + present if ascending else present + absent


@pytest.fixture(params=[1, 5], ids=["one file", "five files"])
def big(request, spark, saved):
    path = saved(ROWS, SCHEMA, "big", files=request.param)
    table = open_table(spark, path)
    return View.of(table).select("k", "s", "x", "t")


@pytest.mark.parametrize("sort", [None, "s", "x", "t"])
@pytest.mark.parametrize("ascending", [True, False])
def test_whole_order_pages_and_rows(big, sort, ascending):
    view = big.sort_by(sort, ascending) if sort else big
    wanted = expected(sort, ascending)
    names = ("k", "s", "x", "t")
    numbered = view.view_rows().orderBy("_view_row")
    assert rows_of(numbered, *names) == wanted
    assert [r._view_row for r in numbered.collect()] == list(range(len(wanted)))
    assert [r._source_row for r in numbered.collect()] == [row[0] + 1 for row in wanted]
    assert rows_of(view.page(1_000, 500), *names) == wanted[1_000:1_500]
    assert rows_of(view.page(2_800, 500), *names) == wanted[2_800:]
    assert rows_of(view.row(1_234), *names) == [wanted[1_233]]
    assert view.row(0).count() == view.row(3_001).count() == view.row(10**12).count() == 0
    part = view.slice(690, 720, ("t", "k")).orderBy("_view_row")
    assert rows_of(part, "t", "k") == [(row[3], row[0]) for row in wanted[690:720]]
    assert [r.k for r in view.ordered().collect()] == [row[0] for row in wanted]


def test_top_page_equals_indexed_page(big, monkeypatch):
    view = big.where(var("t") > "b").sort_by("x", ascending=False)
    top = view.page(700, 300).collect()
    assert view.sort not in view._known
    monkeypatch.setattr(view_module, "TOP_ROWS", 0)
    assert view.page(700, 300).collect() == top
    assert view.sort in view._known
    assert view.hide("s").index().columns == ("k", "x", "t")
    assert "s" not in view.hide("s").page(5, 5).columns


def test_filter_then_sort(big):
    view = big.where(var("s").contains("b")).sort_by("s", ascending=False).select("k")
    wanted = expected("s", False, lambda row: "b" in (row[1] or ""))
    assert rows_of(view.page(0, 5_000), "k") == [(row[0],) for row in wanted]
    assert view.count() == len(wanted)


def python_find(rows, names, columns, text, start, forward):
    def shown(value):
        return "" if value is None else str(value)

    places = [names.index(column) for column in columns]
    hits = [
        i
        for i, row in enumerate(rows)
        if any(text.lower() in shown(row[p]).lower() for p in places)
    ]
    ahead = [i for i in hits if (i > start if forward else i < start)]
    if not (ahead or hits):
        return None
    best = (min if forward else max)(ahead or hits)
    for column, place in zip(columns, places):
        if text.lower() in shown(rows[best][place]).lower():
            return Found(best, column)


@pytest.mark.parametrize(
    "sort, ascending, filtered",
    [(None, True, False), (None, True, True), ("s", True, False), ("x", False, True)],
    ids=["plain", "filtered", "sorted", "both"],
)
def test_find_against_python(big, monkeypatch, sort, ascending, filtered):
    monkeypatch.setattr(search, "FIRST_ROWS", 100)
    view = big.where(var("t") < "m") if filtered else big
    view = (view.sort_by(sort, ascending) if sort else view).select("s", "x", "t")
    wanted = expected(sort, ascending, (lambda row: row[3] < "m") if filtered else lambda row: True)
    names, columns = ["k", "s", "x", "t"], ["s", "x", "t"]
    last = len(wanted)
    for text, start, forward in [
        ("xyz", None, True),
        ("xyz", None, False),
        ("AB", 17, True),
        ("2.5", 1_500, False),
        ("zz", last - 1, True),
        ("1000000000.0", 42, True),
        ("nothing", 5, True),
        ("ba", last + 50, True),
        ("ba", -5, False),
    ]:
        begin = start if start is not None else (-1 if forward else last)
        answer = python_find(wanted, names, columns, text, begin, forward)
        assert find(view, text, start, forward=forward) == answer, (text, start, forward)
        frame = find_frame(view, text, start, forward=forward).collect()
        assert [Found(*row) for row in frame] == ([answer] if answer else [])


def test_text_cells(big):
    from pyspark.sql import functions as F

    shown = {r._source_row: (r.k, r.s, r.x) for r in big.text_cells("Missing").collect()}
    for k, s, x, _ in ROWS:
        x = clean(x)
        wanted = (str(k), "Missing" if s is None else s, "Missing" if x is None else repr(x))
        assert shown[k + 1] == wanted
    assert big.text_cells().filter(F.col("s").isNull()).count() == 0


def test_count_is_remembered(big):
    view = big.where(var("t") < "m")
    assert view.count() == view.sort_by("t").select("k")._known["count"]
    assert "count" not in view.where(var("t") < "c")._known


@pytest.mark.parametrize("stored", [False, True])
def test_filtered_page_reads_from_the_start(big, monkeypatch, stored):
    from tableview import snapshot

    monkeypatch.setattr(view_module, "SCANNED_AT_ONCE", 0)
    monkeypatch.setattr(view_module, "LEADING_ROWS", 50)
    monkeypatch.setattr(view_module, "LEADING_GROWTH", 4)
    view = View.of(snapshot(big.table)).select("k", "s", "x", "t") if stored else big
    wanted = [row[0] for row in expected(None) if row[3] < "c"]
    view = view.where(var("t") < "c").select("k")
    for offset, limit in [(0, 5), (3, 40), (100, 60), (len(wanted) - 5, 50), (len(wanted), 5)]:
        page = rows_of(view.page(offset, limit), "_view_row", "k")
        rows = wanted[offset : offset + limit]
        assert page == [(offset + i, k) for i, k in enumerate(rows)]
    assert view._leading_rows(5).count() < len(wanted)
    assert view._leading_rows(10**6).count() == len(wanted)


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_filtered_index_in_source_order(spark, saved, tmp_path, format):
    """A filter without a sort is numbered without a shuffle, also over many split files."""
    from tableview.sources.table import open_table as opened

    rows = [(i, f"t{i % 11}") for i in range(5_000)]
    path = saved(rows, "k int, t string", "split", files=7)
    if format == "csv":
        frame = spark.read.parquet(path).drop("part").repartitionByRange(5, "k")
        path = str(tmp_path / "split-csv")
        frame.sortWithinPartitions("k").write.csv(path)
    sizes = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    before = {key: spark.conf.get(key) for key in sizes}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        table = opened(spark, path, format=format, schema="k int, t string")
        view = View.of(table).select("k", "t").where(~var("t").is_in("t3", "t4"))
        wanted = [row for row in rows if row[1] not in ("t3", "t4")]
        numbered = view.view_rows().orderBy("_view_row").collect()
        assert [(r._view_row, r.k, r.t) for r in numbered] == [(i, *row) for i, row in enumerate(wanted)]
        part = view.slice(1_995, 2_005).orderBy("_view_row").collect()
        assert [r.k for r in part] == [row[0] for row in wanted[1_995:2_005]]
        view.release()
        assert view._known.keys() <= {"count"}
        assert rows_of(view.page(0, 3), "k") == [(0,), (1,), (2,)]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
