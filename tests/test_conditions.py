"""Conditions against golden rows, against SQLite, and against their validation rules."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sqlite3

import pytest

from tableview import ConditionError, View, any_contains, everything, missing, open_table, var
from tableview.functions.conditions import (
    COMPARISONS,
    _like_pattern,
    from_json,
    successor,
    to_json,
)

SCHEMA = "id int, a string, b string, n double, m double"
NAN, INF = math.nan, math.inf
ROWS = [
    (1, "abc", "ab", 1.0, 2.0),
    (2, None, "ab", None, 2.0),
    (3, "", "x", NAN, 1.0),
    (4, "zz", "", INF, None),
    (5, "ABC", "abc", -INF, NAN),
    (6, "a%c", None, 2.5, 2.5),
    (7, "a\\b", "a", -3.0, -INF),
    (8, "ab\nc", "a_b", 0.0, 0.0),
    (9, "  ab ", "#", 10.0, 3.0),
    (10, "äbc", "ä", 2.0, INF),
    (11, "a_b%", "%", 1e300, 1.0),
]

# (condition, SQL with SQLite's meaning)
CASES = [
    (lambda: var("a") == "abc", "a = 'abc'"),
    (lambda: var("A") != "abc", "a != 'abc'"),
    (lambda: var("a") < "abc", "a < 'abc'"),
    (lambda: var("a") <= "abc", "a <= 'abc'"),
    (lambda: var("a") > "abc", "a > 'abc'"),
    (lambda: var("a") >= "abc", "a >= 'abc'"),
    (lambda: var("n") == 1, "n = 1"),
    (lambda: var("n") != 1, "n != 1"),
    (lambda: var("n") > -5, "n > -5"),
    (lambda: var("n") >= 2.5, "n >= 2.5"),
    (lambda: var("n") < 5, "n < 5"),
    (lambda: var("n") <= 0, "n <= 0"),
    (lambda: var("n") < var("m"), "n < m"),
    (lambda: var("n") == var("m"), "n = m"),
    (lambda: var("a") > var("b"), "a > b"),
    (lambda: var("n").is_in(1, 2.5), "n IN (1, 2.5)"),
    (lambda: var("n").not_in(1, 2.5), "n NOT IN (1, 2.5)"),
    (lambda: var("a").is_in("", "zz"), "a IN ('', 'zz')"),
    (lambda: var("a").not_in("abc"), "a NOT IN ('abc')"),
    (lambda: var("n").between(0, 2.5), "n BETWEEN 0 AND 2.5"),
    (lambda: var("n").between(2.5, 0), "n BETWEEN 2.5 AND 0"),
    (lambda: var("n").not_between(0, 2), "n NOT BETWEEN 0 AND 2"),
    (lambda: var("n").between(var("m"), 3), "n BETWEEN m AND 3"),
    (lambda: var("n").not_between(0, var("m")), "n NOT BETWEEN 0 AND m"),
    (lambda: var("a").contains("b"), "instr(coalesce(a, ''), 'b') > 0"),
    (lambda: var("a").contains(""), "instr(coalesce(a, ''), '') > 0"),
    (lambda: var("a").not_contains("b"), "NOT instr(coalesce(a, ''), 'b') > 0"),
    (lambda: var("a").contains(var("b")), "instr(coalesce(a, ''), coalesce(b, '')) > 0"),
    (lambda: var("a").not_contains(var("b")), "NOT instr(coalesce(a, ''), coalesce(b, '')) > 0"),
    (lambda: var("a").like("a%"), "a LIKE 'a%'"),
    (lambda: var("a").like("a_c"), "a LIKE 'a_c'"),
    (lambda: var("a").like("%b"), "a LIKE '%b'"),
    (lambda: var("a").like("a\\b"), "a LIKE 'a\\b'"),
    (lambda: var("a").like("ab%c"), "a LIKE 'ab%c'"),
    (lambda: var("a").like("ab_c"), "a LIKE 'ab_c'"),
    (lambda: var("a").like(""), "a LIKE ''"),
    (lambda: var("a").like("_bc"), "a LIKE '_bc'"),
    (lambda: var("a").not_like("a%"), "a NOT LIKE 'a%'"),
    (lambda: var("a").like("a#%c", "#"), "a LIKE 'a#%c' ESCAPE '#'"),
    (lambda: var("a").like("a#_%#%", "#"), "a LIKE 'a#_%#%' ESCAPE '#'"),
    (lambda: var("a").like("#a#bc", "#"), "a LIKE '#a#bc' ESCAPE '#'"),
    (lambda: var("b").like("##", "#"), "b LIKE '##' ESCAPE '#'"),
    (lambda: var("b").like("#", "#"), "b LIKE '#' ESCAPE '#'"),
    (lambda: var("b").not_like("%#", "#"), "b NOT LIKE '%#' ESCAPE '#'"),
    (lambda: missing("a"), "a IS NULL OR a = ''"),
    (lambda: missing("n"), "n IS NULL"),
    (lambda: var("a").is_not_missing(), "NOT (a IS NULL OR a = '')"),
    (lambda: var("n").is_not_missing(), "n IS NOT NULL"),
    (lambda: (var("a") == "abc") & (var("n") > 0), "a = 'abc' AND n > 0"),
    (lambda: (var("a") == "abc") | (var("n") > 0), "a = 'abc' OR n > 0"),
    (lambda: ~(var("a") == "abc") | ~(var("n") > 0), "NOT a = 'abc' OR NOT n > 0"),
    (
        lambda: ((var("a") < "b") | missing("b")) & ~(missing("n") | ~(var("m") < 3)),
        "(a < 'b' OR (b IS NULL OR b = '')) AND NOT (n IS NULL OR NOT m < 3)",
    ),
    (lambda: everything(), "1"),
] + [
    (lambda op=op: var("a").prefix(op, "ab"), f"substr(coalesce(a, ''), 1, 2) {op} 'ab'")
    for op in ("=", "!=", "<", "<=", ">", ">=")
] + [
    (
        lambda op=op: var("a").prefix(op, var("b")),
        "substr(coalesce(a, ''), 1, min(length(coalesce(a, '')), length(coalesce(b, ''))))"
        f" {op} substr(coalesce(b, ''), 1, min(length(coalesce(a, '')), length(coalesce(b, ''))))",
    )
    for op in ("=", "!=", "<", "<=", ">", ">=")
]


@pytest.fixture(scope="module")
def sqlite():
    connection = sqlite3.connect(":memory:")
    connection.execute("PRAGMA case_sensitive_like=ON")
    connection.execute("CREATE TABLE t (id INTEGER, a TEXT, b TEXT, n REAL, m REAL)")
    clean = [
        tuple(None if isinstance(v, float) and not math.isfinite(v) else v for v in row)
        for row in ROWS
    ]
    connection.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", clean)
    return connection


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def kept(frame, condition):
    from tableview.catalog import Catalog

    column = condition.column(Catalog.of(frame.schema))
    return {row.id for row in frame.filter(column).select("id").collect()}


@pytest.mark.parametrize("case", range(len(CASES)), ids=[sql for _, sql in CASES])
@pytest.mark.parametrize("negations", [0, 1, 2])
def test_same_rows_as_sqlite(frame, sqlite, case, negations):
    build, sql = CASES[case]
    condition, wanted = build(), f"({sql})"
    for _ in range(negations):
        condition, wanted = ~condition, f"NOT ({wanted})"
    rows = {row[0] for row in sqlite.execute(f"SELECT id FROM t WHERE {wanted}")}
    assert kept(frame, condition) == rows


PREFIX_ROWS = ROWS[:4]


@pytest.mark.parametrize(
    "comparison, literal, column",
    [
        ("=", {1}, {1, 2, 3, 4}),
        ("!=", {2, 3, 4}, set()),
        ("<", {2, 3}, set()),
        ("<=", {1, 2, 3}, {1, 2, 3, 4}),
        (">", {4}, set()),
        (">=", {1, 4}, {1, 2, 3, 4}),
    ],
)
def test_prefix_golden(spark, comparison, literal, column):
    frame = spark.createDataFrame(PREFIX_ROWS, SCHEMA)
    assert kept(frame, var("a").prefix(comparison, "ab")) == literal
    assert kept(frame, var("a").prefix(comparison, var("b"))) == column


def test_escape_patterns():
    assert _like_pattern("a#%c", "#") == "a#%c"
    assert _like_pattern("#a##", "#") == "a##"
    assert _like_pattern("a#", "#") is None
    assert _like_pattern("a\\b", None) == "a\\b"


def test_names_in_any_case_and_values_in_their_own(parcels):
    late = parcels.where((var("LEFT_ON") > var("due_on")) & var("Hub").contains("Oslo"))
    assert [row.parcel for row in late.page().collect()] == ["south/02"]
    capital = parcels.where(var("hub").like("Oslo%"))
    assert [row.pieces for row in capital.page().collect()] == [3, 8, 2]
    assert parcels.where(var("note").not_like("%fragile%")).count() == 5


@pytest.mark.parametrize(
    "build, message",
    [
        (lambda: var("weight") == "18", "weight is numeric"),
        (lambda: var("weight") == True, "weight is numeric"),  # noqa: E712
        (lambda: var("weight").is_in(1, "2"), "weight is numeric"),
        (lambda: var("weight") > NAN, "finite"),
        (lambda: var("weight") > INF, "finite"),
        (lambda: var("weight") > 2**63, "64 bits"),
        (lambda: var("weight") > 10**400, "64 bits"),
        (lambda: var("UNKNOWN") == 1, "has no variable"),
        (lambda: var("weight") == var("UNKNOWN"), "has no variable"),
        (lambda: missing("UNKNOWN"), "has no variable"),
        (lambda: var("hub") == 1, "hub is character"),
        (lambda: var("weight") == var("parcel"), "weight is numeric and parcel"),
        (lambda: var("weight").between(1, var("parcel")), "do not go together"),
        (lambda: var("weight").contains("1"), "CONTAINS"),
        (lambda: var("weight").like("1%"), "LIKE"),
        (lambda: var("hub").like(1), "hub is character"),
        (lambda: var("hub").like("a", "##"), "one character"),
        (lambda: var("weight").starts_with("1"), "prefix"),
        (lambda: var("hub").starts_with(""), "prefix"),
        (lambda: var("hub").starts_with(3), "hub is character"),
        (lambda: var("hub").is_in(), "empty"),
        (lambda: (var("hub") == "Y") & (var("weight") == "x"), "weight is numeric"),
        (lambda: ~(var("weight") == "x"), "weight is numeric"),
    ],
)
def test_validation_before_any_job(parcels, build, message):
    with pytest.raises(ConditionError, match=message):
        parcels.where(build())


def test_conditions_do_not_turn_into_booleans():
    with pytest.raises(TypeError):
        bool(var("a") == "x")


def test_temporal_and_boolean(spark, saved):
    rows = [
        (dt.date(2024, 1, 1), True, dt.datetime(2024, 1, 1, 5)),
        (dt.date(2024, 2, 1), False, dt.datetime(2024, 1, 1, 6)),
        (None, None, None),
    ]
    view = View.of(open_table(spark, saved(rows, "d date, f boolean, t timestamp")))
    assert view.where(var("d") > dt.date(2024, 1, 15)).count() == 1
    assert view.where(var("t") <= dt.datetime(2024, 1, 1, 5)).count() == 1
    assert view.where(var("t") == dt.datetime(2024, 1, 1, 6, tzinfo=dt.UTC)).count() == 1
    assert view.where(var("f") == 1).count() == 1
    assert view.where(~(var("f") == 1)).count() == 1
    assert view.where(missing("d")).count() == 1
    with pytest.raises(ConditionError, match="temporal"):
        view.where(var("d") > "2024-01-15")
    with pytest.raises(ConditionError, match="do not go together"):
        view.where(var("d") > var("f"))


def test_any_column_match_ignores_case_and_reads_numbers_as_text(parcels):
    assert parcels.where(any_contains(["hub", "note"], "oSLO")).count() == 4
    assert parcels.where(any_contains(["weight"], "3.25")).count() == 2
    assert parcels.where(~any_contains(["weight"], "3.25")).count() == 5
    assert parcels.where(any_contains(["weight", "pieces"], "61.0")).count() == 1
    found = parcels.select("note", "due_on").matching("-05-0")
    assert sorted(row.due_on.day for row in found.collect()) == [1, 4, 5, 6, 9]


def test_text_of_conditions():
    condition = (var("hub") == 'a"b') & ~(var("weight").is_in(18, 65))
    assert condition.text == '(hub = "a""b") AND (NOT (weight IN (18, 65)))'
    assert var("A").between(1, var("B")).text == "A BETWEEN 1 AND B"
    assert var("A").like("x#%", "#").text == 'A LIKE "x#%" ESCAPE "#"'


def test_conditions_work_on_streams(spark, saved):
    """A condition is a plain column, so a stream can be filtered with it."""
    from tableview.catalog import Catalog

    path = saved(ROWS, SCHEMA)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    column = (var("a") >= "a").column(Catalog.of(stream.schema))
    query = (
        stream.filter(column)
        .writeStream.format("memory")
        .queryName("filtered_stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.table("filtered_stream").count() == sum(r[1] is not None and r[1] >= "a" for r in ROWS)


PREFIXED = [None, "", "a", "ab", "abc", "ab\U0010ffff", "ac", "b", "\ud7ff", "\ud7ffz", "\ue000", "\U0010ffff", "\U0010ffffz"]


@pytest.mark.parametrize("prefix", ["a", "ab", "\ud7ff", "a\ud7ff", "\U0010ffff", "ab\U0010ffff", "\ue000"])
def test_prefix_ranges_are_comparisons_of_the_leading_characters(spark, saved, prefix):
    view = View.of(open_table(spark, saved([(v,) for v in PREFIXED], "t string")))
    for sign, (compare, _) in COMPARISONS.items():
        # Code points sort like UTF-8 bytes.
        wanted = [v for v in PREFIXED if compare((v or "")[: len(prefix)], prefix)]
        test = var("t").prefix(sign, prefix)
        assert [row.t for row in view.where(test).page().collect()] == wanted, sign
        rest = [v for v in PREFIXED if v not in wanted]
        assert [row.t for row in view.where(~test).page().collect()] == rest, sign


def test_successors():
    assert [successor(p) for p in ("a", "az", "a\U0010ffff", "\U0010ffff", "\ud7ff")] == [
        "b", "a{", "b", None, "\ue000",
    ]


WRITTEN_CONDITIONS = [
    everything(),
    var("pieces") == 3,
    var("weight") != 33.25,
    var("weight") > 1e-300,
    var("weight") <= var("PIECES"),
    var("left_on") >= dt.date(2021, 5, 4),
    var("due_on") < dt.datetime(2021, 5, 9),
    var("pieces") < decimal.Decimal("3.5"),
    *[var("note").prefix(sign, "f") for sign in COMPARISONS],
    var("note").prefix("<=", var("hub")),
    var("hub").starts_with("Os"),
    var("hub").is_in("Oslo", 'say "x"', "ü"),
    var("pieces").not_in(1, 2),
    var("weight").between(1, 40.5),
    var("weight").not_between(1, var("pieces")),
    var("hub").contains("o"),
    var("note").not_contains(var("hub")),
    var("note").like("%100#%%", "#"),
    var("note").not_like("_r%"),
    missing("note"),
    var("hub").is_not_missing(),
    any_contains(["hub", "weight"], "3.2"),
    (var("pieces") > 1) & ~((var("hub") == "Oslo") | missing("due_on")),
]


@pytest.mark.parametrize("condition", WRITTEN_CONDITIONS, ids=lambda c: c.text or "everything")
def test_a_written_condition_is_the_same_condition(parcels, condition):
    again = from_json(to_json(condition))
    assert again.text == condition.text and to_json(again) == to_json(condition)
    keys = [[row.parcel for row in parcels.where(c).page().collect()] for c in (condition, again)]
    assert keys[0] == keys[1]


@pytest.mark.parametrize(
    "text", ["", "{}", "[]", '{"version": 2, "condition": {}}', '{"version": 1, "condition": {"is": "drop", "of": []}}',
             '{"version": 1, "condition": {"number": "x"}}'],
)
def test_other_text_is_no_condition(text):
    with pytest.raises(ConditionError):
        from_json(text)
