"""Find text in the current view: next, previous, wrap-around, and which column shows it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import SOURCE_ROW, VIEW_ROW, quoted
from tableview.functions.text import any_text_contains, shows
from tableview.operators.view import View

# The first range of rows that find looks at, and how much each further range grows. A near
# match then costs one small read, and a far one a handful of ever larger jobs.
FIRST_ROWS = 1_000_000
GROWTH = 16

RESULT = "row_index bigint, column_name string"


@dataclass(frozen=True)
class Found:
    row_index: int
    column_name: str


def _matched_column(view: View, text: str) -> Column:
    """The first visible column that shows the text."""
    variables = [view.table.catalog.exact(name) for name in view.columns]
    hits = [F.when(shows(v, text), F.lit(v.name)) for v in variables]
    return F.coalesce(*hits, F.lit(view.columns[0]))


def _matches(view: View, frame: DataFrame, text: str) -> DataFrame:
    variables = [view.table.catalog.exact(name) for name in view._visible()]
    return frame.filter(any_text_contains(variables, text))


def find_frame(
    view: View, text: str, start: int | None = None, *, forward: bool = True
) -> DataFrame:
    """Find as one lazy query: zero or one row (row_index, column_name).

    Every matching row is ranked by (past the start or not, distance in the direction), so the
    wrap-around is part of the same pass; each task hands on a single candidate.
    """
    view.table.require_complete("finding")
    columns = view._visible()
    if not text:
        return view.table.spark.createDataFrame([], RESULT)
    start = _default_start(view, start, forward)
    row = F.col(VIEW_ROW)
    wrapped = (row <= start) if forward else (row >= start)
    rank = [wrapped.asc(), row.asc() if forward else row.desc()]
    hits = _matches(view, view.index().numbered(), text)
    return hits.orderBy(*rank).limit(1).select(
        row.alias("row_index"), _matched_column(view, text).alias("column_name")
    )


def find(
    view: View, text: str, start: int | None = None, *, forward: bool = True
) -> Found | None:
    """The next (or previous) row after (before) `start` that shows the text, wrapping around.

    From an end of a view without an index nothing is sorted: the first match is a top-1 and
    its number is the count of rows before it. Otherwise the index is searched outwards from
    the start in growing ranges, each reading just its own files, and of these only the ones that
    may show the text if the view has a skip index (`View.index_text`).
    """
    view.table.require_complete("finding")
    view._visible()
    if not text:
        return None
    from_end = start is None or (start < 0 if forward else start >= view.count())
    plain = view.condition is None and view.sort is None
    only = view._indexed_files(text)
    if only is not None and not only:
        return None
    if from_end and not plain and view.sort not in view._known:
        return _find_from_end(view, text, forward)
    start = _default_start(view, start, forward)
    index = view.index()
    total = index.total()
    if forward:
        start = max(start, -1)
        spans = [(start + 1, total), (0, min(start + 1, total))]
    else:
        start = min(start, total)
        spans = [(0, start), (max(start, 0), total)]
    for low, high in spans:
        for begin, end in _growing(low, high, forward):
            if only is not None and not index.holds(begin, end, only):
                continue
            hits = _matches(view, index.between(begin, end, only), text)
            order = F.col(VIEW_ROW).asc() if forward else F.col(VIEW_ROW).desc()
            hit = hits.orderBy(order).limit(1).select(VIEW_ROW, _matched_column(view, text)).first()
            if hit is not None:
                return Found(hit[0], hit[1])
    return None


def _default_start(view: View, start: int | None, forward: bool) -> int:
    if start is not None:
        return start
    return -1 if forward else view.count()


def _growing(low: int, high: int, forward: bool):
    size = FIRST_ROWS
    while low < high:
        if forward:
            yield low, min(low + size, high)
            low += size
        else:
            yield max(high - size, low), high
            high -= size
        size *= GROWTH


def _find_from_end(view: View, text: str, forward: bool) -> Found | None:
    key = quoted(view.sort.variable) if view.sort else F.lit(None).cast("int")
    carried, restored = _carrying(view)
    candidates = _matches(view, view._sortable(), text).select(
        key.alias("_key"), carried(key).alias("_carried"), SOURCE_ROW, _matched_column(view, text).alias("column_name")
    )
    rank = [F.col("_key"), F.col(SOURCE_ROW)]
    ascending = view.sort.ascending if view.sort else True
    if forward == ascending:
        first = rank[0].asc_nulls_first()
    else:
        first = rank[0].desc_nulls_last()
    second = rank[1].asc() if forward else rank[1].desc()
    hit = candidates.orderBy(first, second).limit(1).first()
    if hit is None:
        return None
    limit = None if hit["_carried"] is None else restored(hit["_carried"])
    before = view._sortable().filter(_comes_before(view, limit, hit[SOURCE_ROW])).count()
    return Found(before, hit["column_name"])


def _carrying(view: View):
    """How the sort key of the match comes to the driver and back: times as whole numbers, which
    no time zone can shift, everything else as it is."""
    kind = view.table.catalog.exact(view.sort.variable).data_type if view.sort else None
    if isinstance(kind, T.TimestampType):
        return F.unix_micros, lambda value: F.timestamp_micros(F.lit(value))
    if isinstance(kind, T.DateType):
        return F.unix_date, lambda value: F.date_from_unix_date(F.lit(value))
    if isinstance(kind, (T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return lambda key: key.cast("string"), lambda value: F.lit(value).cast(kind)
    return lambda key: key, F.lit


def _comes_before(view: View, key: Column | None, source_row: int) -> Column:
    """Rows ahead of the row with this sort key and source row, missing keys being lowest."""
    earlier = F.col(SOURCE_ROW) < source_row
    if view.sort is None:
        return earlier
    column = quoted(view.sort.variable)
    if key is None:
        tied = column.isNull() & earlier
        return tied if view.sort.ascending else column.isNotNull() | tied
    tied = (column == key) & earlier
    if view.sort.ascending:
        return column.isNull() | (column < key) | tied
    return (column > key) | tied
