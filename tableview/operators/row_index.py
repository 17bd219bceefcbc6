"""Row numbers of a view.

A sorted or filtered view is written once as Parquet in the shared folder. Where a row lies in
those files tells its number, so numbering needs no global window, any range of rows means
reading just the files that hold it, and a lost executor costs nothing: the order was fixed when
the files were committed, not when a range partitioning happened to be sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableview import storage
from tableview.catalog import SOURCE_ROW, VIEW_ROW, quoted
from tableview.operators.text_index import TextIndex
from tableview.sources.ordered_files import OrderedFiles
from tableview.sources.table import ORIGIN_BLOCK, ORIGIN_FILE, ROWS_PER_FILE, Table, publish


@dataclass(frozen=True)
class RowIndex:
    columns: tuple[str, ...]
    all_rows: Callable[[], DataFrame]
    # Rows between two numbers, of all files or of the named ones.
    rows_between: Callable[[int, int, set[str] | None], DataFrame]
    total: Callable[[], int]
    drop: Callable[[], None]
    # The rows as they are stored, and whether some files have any between two numbers.
    stored: DataFrame
    holds: Callable[[int, int, set[str]], bool]
    text: TextIndex | None = None

    def showing(self, columns: tuple[str, ...]) -> RowIndex:
        return replace(self, columns=columns)

    def _shown(self, frame: DataFrame) -> DataFrame:
        return frame.select(VIEW_ROW, SOURCE_ROW, *map(quoted, self.columns))

    def numbered(self) -> DataFrame:
        return self._shown(self.all_rows())

    def between(self, start: int, stop: int, only: set[str] | None = None) -> DataFrame:
        return self._shown(self.rows_between(max(start, 0), max(stop, 0), only))

    def files_with(self, text: str) -> set[str] | None:
        """The files that may show the text; None where only reading them can tell."""
        if self.text is None or not set(self.columns) <= set(self.text.names):
            return None
        return self.text.files(text)


def source_index(
    table: Table, columns: tuple[str, ...], text: TextIndex | None = None
) -> RowIndex:
    """An unfiltered view in source order: the row number is the source row."""

    def numbered(frame: DataFrame) -> DataFrame:
        rows = table.clean(frame, table.catalog.names)
        return rows.withColumn(VIEW_ROW, F.col(SOURCE_ROW) - 1)

    def holds(start: int, stop: int, only: set[str]) -> bool:
        if table.files is None or table.files.single_file:
            return bool(only)
        return table.files.holds(start, stop, only)

    return RowIndex(
        columns,
        lambda: numbered(table.numbered),
        lambda start, stop, only=None: numbered(table.source_range(start, stop, only)),
        lambda: table.status().cached_rows,
        lambda: None,
        table.rows,
        holds,
        text,
    )


def sorted_index(
    spark: SparkSession, parts: Iterable[DataFrame], columns: tuple[str, ...]
) -> RowIndex:
    """Write frames that follow each other in order and number their rows by where they lie."""
    return _written_index(spark, parts, columns, None)


def filtered_index(spark: SparkSession, kept: DataFrame, columns: tuple[str, ...]) -> RowIndex:
    """Write the rows of a condition in source order, without a shuffle.

    Each task writes the rows of the blocks it reads as it finds them, marked with file and
    block; the order of the blocks is that of the source.
    """
    return _written_index(spark, [kept], columns, (ORIGIN_FILE, ORIGIN_BLOCK))


def _written_index(
    spark: SparkSession,
    parts: Iterable[DataFrame],
    columns: tuple[str, ...],
    origin: tuple[str, str] | None,
) -> RowIndex:
    path = storage.new_path(spark, "index")
    try:
        for number, part in enumerate(parts):
            publish(part, f"{path}/range-{number}", ROWS_PER_FILE)
    except BaseException:
        storage.delete(spark, path)
        raise
    reader = spark.read.schema(part.schema).option("recursiveFileLookup", "true")
    files = OrderedFiles(spark, reader.parquet(path), origin)
    return RowIndex(
        columns,
        lambda: files.numbered(VIEW_ROW),
        lambda start, stop, only=None: files.between(start, stop, VIEW_ROW, 0, only),
        lambda: files.total,
        lambda: storage.delete(spark, path),
        files.frame,
        files.holds,
    )
