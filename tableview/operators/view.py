"""The view: visible columns, a condition and a stable sort over one table.

A view never changes; each step returns a new one, so an earlier view stays usable whatever
happens to a later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableview.catalog import SOURCE_ROW, VIEW_ROW, quoted
from tableview.errors import ColumnSelectionError
from tableview.functions.conditions import Condition, any_contains
from tableview.functions.text import any_text_contains, csv_line, display_text
from tableview.operators.row_index import RowIndex, filtered_index, sorted_index, source_index
from tableview.operators.text_index import build_text_index
from tableview.sources.ordered_files import (
    partition_count,
    scan_tasks,
    sorted_parts,
    sorted_rows,
    thinned,
)
from tableview.sources.table import Table

# Rows per page, the usual number and the bounds it is kept within.
PAGE_ROWS = 500
LEAST_PAGE_ROWS = 50
MOST_PAGE_ROWS = 5_000

# A page is a top-k over the view as long as it ends within this many rows: every task holds so
# many. Pages further down come from the row index.
TOP_ROWS = 4 * MOST_PAGE_ROWS

# A filtered page in source order looks at this many rows of the table first, and at this many
# times more as long as too few pass; a table of up to so many bytes is simply read.
LEADING_ROWS = 4_000_000
LEADING_GROWTH = 16
SCANNED_AT_ONCE = 1024**3

# Under which the skip index of the table itself is remembered; those of other indexes go with them.
TEXT = "text"


def page_rows(wanted: int = PAGE_ROWS) -> int:
    return min(max(wanted, LEAST_PAGE_ROWS), MOST_PAGE_ROWS)


def page_start(row: int, size: int = PAGE_ROWS) -> int:
    """First row of the page that holds this row (both counted from 0)."""
    return row - row % size


@dataclass(frozen=True)
class Sort:
    variable: str
    ascending: bool = True

    def keys(self) -> list[Column]:
        key = quoted(self.variable)
        return [
            key.asc_nulls_first() if self.ascending else key.desc_nulls_last(),
            F.col(SOURCE_ROW).asc(),
        ]


@dataclass(frozen=True)
class View:
    table: Table
    columns: tuple[str, ...]
    condition: Condition | None = None
    sort: Sort | None = None
    # Counts and indexes already made; shared by views that keep the same rows.
    _known: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, table: Table) -> View:
        return cls(table, tuple(table.catalog.names))

    # ---- visible columns ----------------------------------------------------------------

    def select(self, *names: str) -> View:
        """Show exactly these variables in this order."""
        if not names:
            raise ColumnSelectionError("select at least one known variable")
        for name in names:
            self.table.catalog.exact(name)
        return replace(self, columns=tuple(names))

    def hide(self, *names: str) -> View:
        return replace(self, columns=tuple(c for c in self.columns if c not in names))

    def show(self, *names: str) -> View:
        """Show hidden variables again, after the ones already visible."""
        for name in names:
            self.table.catalog.exact(name)
        added = tuple(name for name in names if name not in self.columns)
        return replace(self, columns=self.columns + added)

    def toggle_all(self) -> View:
        """Hide everything if everything is visible, else show everything in catalog order."""
        names = tuple(self.table.catalog.names)
        return replace(self, columns=() if len(self.columns) == len(names) else names)

    def _visible(self) -> tuple[str, ...]:
        if not self.columns:
            raise ColumnSelectionError("the view shows no variable; show at least one")
        return self.columns

    # ---- condition and sort -------------------------------------------------------------

    def where(self, condition: Condition | None) -> View:
        """Replace the condition; None or an empty one shows all rows again."""
        self.table.require_complete("filtering")
        if condition is not None and condition.text:
            condition.column(self.table.catalog)
        else:
            condition = None
        return replace(self, condition=condition, _known={})

    def sort_by(self, variable: str, ascending: bool = True) -> View:
        """Sort by one variable; equal values keep their source order."""
        self.table.require_complete("sorting")
        self.table.catalog.exact(variable)
        return replace(self, sort=Sort(variable, ascending))

    def in_source_order(self) -> View:
        return replace(self, sort=None)

    def order(self) -> list[Column]:
        return self.sort.keys() if self.sort else [F.col(SOURCE_ROW).asc()]

    # ---- rows ---------------------------------------------------------------------------

    def _kept(self, frame: DataFrame) -> DataFrame:
        """The condition on stored columns, below any cleaning, so that it reaches the scan."""
        if self.condition is None:
            return frame
        return frame.filter(self.condition.column(self.table.catalog))

    def rows(self) -> DataFrame:
        """The view's rows in no particular order, with `_source_row`."""
        return self._rows_with(()).select(SOURCE_ROW, *map(quoted, self._visible()))

    def _rows_with(self, extra: tuple[str, ...]) -> DataFrame:
        hidden = [name for name in extra if name not in self.columns]
        return self.table.clean(self._kept(self.table.numbered), [*self._visible(), *hidden])

    def _sortable(self) -> DataFrame:
        return self._rows_with((self.sort.variable,) if self.sort else ())

    def ordered(self) -> DataFrame:
        """The whole view in order."""
        ranged = sorted_rows(self._sortable(), self.order(), self._sorted_bytes())
        return ranged.select(SOURCE_ROW, *map(quoted, self.columns))

    def ordered_parts(self) -> Iterator[DataFrame]:
        """The whole view in order, as frames that follow each other: one, or several for a table
        too big to be sorted by one shuffle. Each has to be used before the next is asked for."""
        for part in sorted_parts(self._sortable(), self.order(), self._sorted_bytes()):
            yield part.select(SOURCE_ROW, *map(quoted, self.columns))

    def _sorted_bytes(self) -> int:
        """About the size of what a sort moves: the share of the table that the rows kept and the
        columns shown have. The rows are only counted for a table that is big as a whole."""
        size = self.table.source_bytes
        usual = int(self.table.spark.conf.get("spark.sql.shuffle.partitions"))
        if partition_count(self.table.spark, size) <= usual:
            return size
        fields = self.table.unnumbered._jdf.schema().fields()
        widths = {field.name(): field.dataType().defaultSize() for field in fields}
        moved = {*self.columns, *((self.sort.variable,) if self.sort else ())}
        share = sum(widths[name] for name in moved) / max(1, sum(widths.values()))
        if self.condition is not None:
            share *= self.count() / max(1, self.table.row_count)
        return int(size * share)

    def text_cells(self, missing: str = "") -> DataFrame:
        """The view's cells as text, with `_source_row`."""
        variables = [self.table.catalog.exact(name) for name in self._visible()]
        return self._kept(self.table.numbered).select(
            SOURCE_ROW, *[display_text(v, missing).alias(v.name) for v in variables]
        )

    def matching(self, text: str) -> DataFrame:
        """Rows of the view where any visible cell shows the text."""
        only = self._indexed_files(text)
        if only is None:
            return self.where(self._and(any_contains(list(self._visible()), text))).rows()
        index = self.index()
        variables = [self.table.catalog.exact(name) for name in self._visible()]
        rows = index.between(0, index.total(), only)
        return rows.filter(any_text_contains(variables, text)).drop(VIEW_ROW)

    def _indexed_files(self, text: str) -> set[str] | None:
        """The files that may show the text, if a skip index tells."""
        plain = self.condition is None and self.sort is None
        if not text or (TEXT not in self._known if plain else self.sort not in self._known):
            return None
        return self.index().files_with(text)

    def _and(self, condition: Condition) -> Condition:
        return condition if self.condition is None else self.condition & condition

    # ---- counts -------------------------------------------------------------------------

    def count(self) -> int:
        """Rows that pass the condition; counted once and then remembered."""
        if "count" not in self._known:
            self._known["count"] = self._kept(self.table.unnumbered).count()
        return self._known["count"]

    def summary(self) -> DataFrame:
        """Filtered rows, total rows, visible columns, and whether a condition is set.

        The two counts stay apart so that the filtered one is pushed into the scan and the
        total needs file footers only.
        """
        filtered = self._kept(self.table.unnumbered).agg(
            F.count(F.lit(1)).alias("filtered_rows"), F.lit(0).cast("bigint").alias("total_rows")
        )
        total = self.table.unnumbered.agg(
            F.lit(0).cast("bigint").alias("filtered_rows"), F.count(F.lit(1)).alias("total_rows")
        )
        return filtered.unionAll(total).agg(
            F.sum("filtered_rows").alias("filtered_rows"),
            F.sum("total_rows").alias("total_rows"),
            F.lit(len(self.columns)).alias("visible_columns"),
            F.lit(self.condition is not None).alias("filtered"),
        )

    # ---- pages --------------------------------------------------------------------------

    def index(self) -> RowIndex:
        """The view's row numbers, counted from 0; made once per condition and sort.

        Unfiltered in source order they follow from the table. Otherwise the visible columns
        are written once, which needs a shuffle only for a sort; hiding columns later does not
        make the index stale.
        """
        columns = self._visible()
        if self.condition is None and self.sort is None:
            return source_index(self.table, columns, self._known.get(TEXT))
        known = self._known.get(self.sort)
        if known is None or not set(columns) <= set(known.columns):
            located = self.table.located if self.sort is None else None
            if located is None:
                known = sorted_index(self.table.spark, self.ordered_parts(), columns)
            else:
                kept = self.table.clean(self._kept(located), columns)
                known = filtered_index(self.table.spark, kept, columns)
            if self.sort in self._known:
                # Frames made from the narrower index may still be read: it goes with release().
                self._known.setdefault("replaced", []).append(self._known[self.sort])
            self._known[self.sort] = known
        return known.showing(columns)

    def index_text(self) -> View:
        """Write a skip index beside the row index: find and `matching` then read only the files
        that may show the text. It covers the columns visible now and goes with `release()`."""
        index = self.index()
        variables = [self.table.catalog.exact(name) for name in self._visible()]
        if index.text is not None and set(self.columns) <= set(index.text.names):
            return self
        stored = index.stored
        if self.condition is None and self.sort is None:
            shown = {v.name: v.value for v in variables if v.name not in self.table.derive}
            shown |= {name: column for name, column in self.table.derive.items()}
            text = build_text_index(stored, variables, shown)
            replaced = self._known.pop(TEXT, None)
            self._known[TEXT] = text
        else:
            text = build_text_index(stored, variables)
            replaced = self._known[self.sort].text
            self._known[self.sort] = replace(self._known[self.sort], text=text)
        if replaced is not None:
            replaced.drop()
        return self

    def release(self) -> None:
        """Delete the indexes this view has written."""
        every = self._known.pop("replaced", [])
        every += [self._known.pop(key) for key in [key for key in self._known if key != "count"]]
        for known in every:
            if getattr(known, "text", None) is not None:
                known.text.drop()
            known.drop()

    def view_rows(self) -> DataFrame:
        """Every row with `_view_row`, its 0-based position in the view."""
        self.table.require_complete("numbering the view")
        return self.index().numbered()

    def page(self, offset: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
        """`limit` rows from row `offset` on, in order, with `_view_row`."""
        columns = self._visible()
        plain = self.condition is None and self.sort is None
        if plain or self.sort in self._known or offset + limit > TOP_ROWS:
            return self.slice(offset, offset + limit).orderBy(VIEW_ROW).limit(limit)
        rows = self._leading_rows(offset + limit) if self.sort is None else self._sortable()
        tasks = scan_tasks(self.table.spark, self.table.source_bytes, self.table.file_count)
        ranked = thinned(rows, self.order(), offset + limit, tasks).orderBy(*self.order())
        # A global limit leaves one sorted partition, so the ids on it count 0, 1, 2, ...
        position = F.lit(offset).cast("bigint") + F.monotonically_increasing_id()
        page = ranked.offset(offset).limit(limit).withColumn(VIEW_ROW, position)
        return page.select(VIEW_ROW, *map(quoted, columns))

    def _leading_rows(self, needed: int) -> DataFrame:
        """Rows of a filtered view in source order, from the start of the table on.

        In a big table the first rows that pass usually lie near its start, so growing ranges
        of it are counted until they hold enough; only when they never do is all of it read.
        """
        stop = LEADING_ROWS
        if self.table.source_bytes > SCANNED_AT_ONCE:
            total = self.table.row_count
            while stop < total:
                part = self._kept(self.table.source_range(0, stop))
                if part.count() >= needed:
                    return self.table.clean(part, self._visible())
                stop *= LEADING_GROWTH
        return self._sortable()

    def slice(self, start: int, stop: int, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Rows start <= row < stop (from 0) of the given or all visible columns."""
        for name in columns or ():
            self.table.catalog.exact(name)
        shown = columns or self._visible()
        return self.index().between(start, stop).select(VIEW_ROW, *map(quoted, shown))

    def row(self, number: int) -> DataFrame:
        """One row by its 1-based number in the view; no row when out of range."""
        self.table.require_complete("going to a row")
        return self.page(number - 1, 1) if number >= 1 else self.slice(0, 0)

    # ---- text ---------------------------------------------------------------------------

    def csv_lines(self) -> DataFrame:
        """Each row as a CSV record, with `_view_row`."""
        variables = [self.table.catalog.exact(name) for name in self._visible()]
        return self.view_rows().select(VIEW_ROW, csv_line(variables).alias("line"))

    def copied_block(
        self,
        start: int,
        stop: int,
        columns: tuple[str, ...] | None = None,
        headers: bool = False,
    ) -> DataFrame:
        """A rectangle of cells as tab-separated lines, with `_view_row` (-1 for the headers)."""
        names = columns or self._visible()
        variables = [self.table.catalog.exact(name) for name in names]
        cells = self.slice(start, stop, tuple(names))
        lines = cells.select(
            VIEW_ROW, F.concat_ws("\t", *[display_text(v) for v in variables]).alias("line")
        )
        if not headers:
            return lines
        first = self.table.spark.range(1).select(
            F.lit(-1).cast("bigint").alias(VIEW_ROW), F.lit("\t".join(names)).alias("line")
        )
        return first.unionAll(lines)
