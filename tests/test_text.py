"""Number text and CSV records against Python's own."""

from __future__ import annotations

import csv
import io
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableview import View, export_csv, open_table, var
from tableview.sources.ordered_files import natural_order
from tableview.functions.text import csv_header, number_text
from tableview.operators.export import exported_parts

FIXED = [
    0.0, -0.0, 1.0, -45.0, 0.3, 0.1 + 0.2, 1e-3, 1e-4, 0.000123, 9.99e-5, 1e-5, -2.5e-7, 1e7,
    9999999.0, 123456789.0, 1234567.891, 1e15, 1.5e15, 1e16, 1e17, 1e22, 1e100, -1e-100, 1 / 3,
]


def texts(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    return frame.select("x", number_text(F.col("x")).alias("t")).collect()


def test_number_text_fixed(spark):
    for row in texts(spark, FIXED):
        assert row.t == repr(row.x)


def test_number_text_everyday_range(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 15) for _ in range(20_000)]
    values += [round(v, rng.randint(0, 8)) for v in values]
    checked = [v for v in values if v == 0 or 1e-4 <= abs(v) < 1e16]
    wrong = [(row.x, row.t) for row in texts(spark, checked) if row.t != repr(row.x)]
    assert not wrong
    assert all(float(row.t) == row.x for row in texts(spark, values))


def python_csv(names, rows):
    stream = io.StringIO()
    writer = csv.writer(stream, lineterminator="\n")
    writer.writerow(names)
    writer.writerows([["" if v is None else v for v in row] for row in rows])
    return b"\xef\xbb\xbf" + stream.getvalue().encode()


CSV_ROWS = [
    ("plain", 1.0),
    ("with,comma", 0.5),
    ('with "quote"', None),
    ("line\nbreak", 1e16),
    ("carriage\rreturn", -1e-5),
    ("  blanks  ", 123456789.25),
    (None, None),
    ("", 0.1),
    ('"', 7.0),
    ("ünïcode 漢字", 2.0),
]


def exported(spark, view, tmp_path, **options):
    done = export_csv(view, str(tmp_path / "out.csv"), single_file=True, **options)
    return done, (tmp_path / "out.csv").read_bytes()


def test_export_bytes(spark, saved, tmp_path):
    path = saved(CSV_ROWS, "`a,\"b\"` string, n double")
    view = View.of(open_table(spark, path))
    done, data = exported(spark, view, tmp_path)
    assert data == python_csv(['a,"b"', "n"], CSV_ROWS)
    assert (done.rows, done.single_file) == (len(CSV_ROWS), True)
    assert sorted(p.name for p in tmp_path.iterdir() if "out.csv" in p.name) == ["out.csv"]


def test_export_single_column_keeps_empty_rows(spark, saved, tmp_path):
    view = View.of(open_table(spark, saved([("a",), (None,), ("",), ("b",)], "c string")))
    _, data = exported(spark, view, tmp_path)
    assert data == python_csv(["c"], [("a",), (None,), ("",), ("b",)])


def test_export_of_a_filtered_sorted_view(parcels, tmp_path):
    view = parcels.where(var("pieces") <= 2).select("note", "weight", "due_on").sort_by("parcel")
    # The suffix is added.
    done = export_csv(view, str(tmp_path / "small parcels"), single_file=True)
    assert done.rows == 4 and done.path.endswith("small parcels.csv")
    lines = (tmp_path / "small parcels.csv").read_bytes().decode("utf-8-sig").splitlines()
    assert lines == [
        "note,weight,due_on",
        "left at door,33.25,2021-05-20",
        ",0.75,2021-05-04",
        ",,2021-05-06",
        '"say ""hi""",61.0,2021-05-05',
    ]


def test_export_replaces_and_orders_many_parts(spark, saved, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(5_000)]
    view = View.of(open_table(spark, saved(rows, "k int, x double"))).sort_by("x", False)
    (tmp_path / "out.csv").write_text("old")
    for option in ("false", "true"):  # with and without merged partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", option)
        done, data = exported(spark, view, tmp_path)
        ordered = sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))
        assert data == python_csv(["k", "x"], ordered)
        assert done.rows == 5_000


def test_export_in_parts(spark, saved, tmp_path):
    rows = [(i, f"t{i}") for i in range(1_000)]
    view = View.of(open_table(spark, saved(rows, "k int, t string"))).sort_by("k", False)
    done = export_csv(view, str(tmp_path / "big.csv"), single_file=False)
    assert not done.single_file and done.rows == 1_000
    folder = tmp_path / "big.csv.parts"
    names = (folder / "_order").read_text().split()
    assert sorted(names) == sorted(p.name for p in folder.iterdir() if p.name[0] not in "._")
    joined = b"".join((folder / name).read_bytes() for name in names)
    assert joined == python_csv(["k", "t"], rows[::-1])
    assert not (tmp_path / "big.csv").exists()


def test_parts_beyond_99999_stay_in_order():
    names = [f"part-{n:05d}-x-c000.txt" for n in (100_000, 99_999, 9, 10_001)]
    assert [name[5:-11] for name in sorted(names, key=natural_order)] == [
        "00009", "10001", "99999", "100000",
    ]


def test_failed_export_keeps_the_old_file(spark, saved, tmp_path):
    table = open_table(
        spark,
        saved([(1,)], "k int"),
        derive={"broken": F.raise_error(F.lit("unreadable")).cast("string")},
    )
    (tmp_path / "out.csv").write_text("old")
    with pytest.raises(Exception, match="unreadable"):
        export_csv(View.of(table), str(tmp_path / "out.csv"), single_file=True)
    assert [p.name for p in tmp_path.iterdir() if "out" in p.name] == ["out.csv"]
    assert (tmp_path / "out.csv").read_text() == "old"


def test_failed_export_in_parts_keeps_the_one_before(spark, saved, tmp_path):
    rows = [(i, "x" if i else "bad") for i in range(100)]
    path = saved(rows, "k int, t string")
    good = View.of(open_table(spark, path)).sort_by("k")
    folder = export_csv(good, str(tmp_path / "out.csv")).path
    first = [name.rsplit("/", 1)[-1] for name in exported_parts(spark, folder)]
    broken = {"t": F.when(F.col("t") == "bad", F.raise_error(F.lit("unreadable"))).otherwise("y")}
    with pytest.raises(Exception, match="unreadable"):
        export_csv(View.of(open_table(spark, path, derive=broken)).sort_by("k"), str(tmp_path / "out.csv"))
    assert [name.rsplit("/", 1)[-1] for name in exported_parts(spark, folder)] == first
    joined = b"".join((tmp_path / "out.csv.parts" / name).read_bytes() for name in first)
    assert joined == python_csv(["k", "t"], rows)
    # The next one takes its place and leaves nothing of it.
    export_csv(good.where(var("k") < 5).select("k"), str(tmp_path / "out.csv"))
    second = [name.rsplit("/", 1)[-1] for name in exported_parts(spark, folder)]
    assert not set(first) & {p.name for p in (tmp_path / "out.csv.parts").iterdir()}
    joined = b"".join((tmp_path / "out.csv.parts" / name).read_bytes() for name in second)
    assert joined == python_csv(["k"], [(i,) for i in range(5)])


def test_number_text_does_not_grow_with_its_column(spark):
    column = F.col("x")
    for at in range(6):
        column = F.when(column > at, column * 2).otherwise(column + at)
    frame = spark.createDataFrame([(float(at),) for at in range(3)], "x double")
    shown = frame.select(number_text(column).alias("t"))
    # The text of the rare numbers stands in the plan once.
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4
    assert [row.t for row in shown.collect()] == [
        repr(row[0]) for row in frame.select(column).collect()
    ]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.text(alphabet=st.sampled_from('ab,"\n\r \t\'é;'), max_size=6)),
            st.one_of(st.none(), st.text(alphabet=st.sampled_from('x,"\n\\'), max_size=4)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_csv_lines_against_python(spark, rows):
    from tableview.catalog import Catalog
    from tableview.functions.text import csv_line

    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, a string, b string")
    variables = Catalog.of(frame.schema).variables[1:]
    lines = [r.line for r in frame.select("i", csv_line(variables).alias("line")).orderBy("i").collect()]
    text = "".join(line + "\n" for line in lines)
    assert python_csv(["a", "b"], rows) == b"\xef\xbb\xbfa,b\n" + text.encode()


def test_header():
    assert csv_header(["a", 'b"c', "d,e", "f\ng"]) == 'a,"b""c","d,e","f\ng"'


def test_nonfinite_numbers_show_as_missing(spark, saved):
    view = View.of(open_table(spark, saved([(math.nan,), (math.inf,), (1.0,)], "x double")))
    assert [r.x for r in view.text_cells(".").orderBy("_source_row").collect()] == [".", ".", "1.0"]


def test_number_text_is_the_shortest_over_the_whole_range(spark):
    import struct

    rng = random.Random(5)
    values = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(20_000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    values += [10.0**e * rng.uniform(1, 10) for e in range(14, 25) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", number_text(F.col("v")).alias("t")).collect()
    wrong = [(row.v, row.t) for row in rows if row.t != repr(row.v)]
    assert not wrong, wrong[:5]
