"""Open a table: its rows in source order, its catalog, and how complete it is."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview import storage
from tableview.catalog import SOURCE_ROW, VIEW_ROW, Catalog, contents, quoted
from tableview.errors import IncompleteTableError, TableViewError
from tableview.sources.ordered_files import FILE, NAMED_FILES, OrderedFiles

ORIGIN_FILE = "_origin_file"
ORIGIN_BLOCK = "_origin_block"

# In the metadata of a stored `_source_row`: this library wrote it.
NUMBERED = "tableview_source_row"

# Rows per file of the tables this library writes: a page then touches one or two small files.
ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class IngestStatus:
    cached_rows: int
    total_rows: int
    complete: bool


@dataclass(frozen=True)
class Table:
    """An opened table. It holds no rows; every read is planned when it is asked for.

    `rows` are the rows as stored, `files` numbers them. When the source row number is already
    a stored column (`files` is None) ranges of rows are found by pushing a filter on it.
    `complete` is false for the part of a table that had arrived while it was still loading.
    """

    spark: SparkSession
    path: str
    rows: DataFrame
    catalog: Catalog
    files: OrderedFiles | None
    derive: Mapping[str, Column] = field(default_factory=dict)
    complete: bool = True
    expected_rows: int = 0
    # The folder of a copy that belongs to this table alone.
    owned: str | None = None

    def release(self) -> None:
        """Delete the copy this table was opened from, if the library made one for it."""
        if self.owned is not None:
            storage.delete(self.spark, self.owned)

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")

    def _shaped(self, frame: DataFrame, numbered: bool, extra: tuple = ()) -> DataFrame:
        kept = [column for column in frame.columns if column not in self.derive]
        order = [SOURCE_ROW] if numbered else []
        known = [name for name in self.catalog.names if name in kept]
        return frame.select(
            *[F.col(name) for name in (*order, *extra)],
            *[quoted(name) for name in known],
            *[column.alias(name) for name, column in self.derive.items()],
        )

    @property
    def unnumbered(self) -> DataFrame:
        """The rows as stored, for what needs no order (counts)."""
        return self._shaped(self.rows, numbered=False)

    @property
    def numbered(self) -> DataFrame:
        """The rows as stored with `_source_row`, counted from 1."""
        if self.files is None:
            return self._shaped(self.rows, numbered=True)
        return self._shaped(self.files.numbered(SOURCE_ROW, base=1), numbered=True)

    @property
    def located(self) -> DataFrame | None:
        """The numbered rows with the file and block they were read from.

        None where numbering moves rows or their order does not follow from where they lie.
        """
        if self.files is None or not self.files.keeps_order:
            return None
        frame = self.files.numbered(SOURCE_ROW, 1, with_origin(self.files.frame))
        return self._shaped(frame, numbered=True, extra=(ORIGIN_FILE, ORIGIN_BLOCK))

    def source_range(self, start: int, stop: int, only: set[str] | None = None) -> DataFrame:
        """Stored rows at positions start <= p < stop of the source order (from 0), of some files
        only if they are named."""
        if self.files is None:
            row = F.col(SOURCE_ROW)
            frame = self.rows.filter((row > start) & (row <= stop))
            if only is not None and len(only) <= NAMED_FILES:
                frame = frame.filter(F.col(FILE).isin(*only) if only else F.lit(False))
        else:
            frame = self.files.between(start, stop, SOURCE_ROW, 1, only)
        return self._shaped(frame, numbered=True)

    @property
    def with_source_row(self) -> DataFrame:
        """All rows, cleaned, with `_source_row`."""
        return self.clean(self.numbered, self.catalog.names)

    def clean(self, frame: DataFrame, names) -> DataFrame:
        """Project to the named variables with their cleaned values, row numbers first."""
        order = [c for c in frame.columns if c in (SOURCE_ROW, ORIGIN_FILE, ORIGIN_BLOCK)]
        return frame.select(*order, *[self.catalog.exact(name).value for name in names])

    @property
    def row_count(self) -> int:
        """All rows, from file footers."""
        return self.rows.count() if self.files is None else self.files.total

    @property
    def source_bytes(self) -> int:
        """Stored size: the shape of the sort that a view over this table needs."""
        if self.files is not None and not self.files.single_file:
            return self.files.bytes
        listed = storage.list_files(self.spark, self.path)
        return sum(size for _, size in listed)

    @property
    def file_count(self) -> int:
        if self.files is None:
            return len(storage.list_files(self.spark, self.path))
        return 1 if self.files.single_file else len({run.file for run in self.files.runs})

    def contents(self, search: str = "") -> DataFrame:
        return contents(self.spark, self.unnumbered, self.catalog, search)

    def status(self) -> IngestStatus:
        rows = self.unnumbered.count()
        total = rows if self.complete else max(rows, self.expected_rows)
        return IngestStatus(rows, total, self.complete)

    def require_complete(self, action: str) -> None:
        if not self.complete:
            raise IncompleteTableError(f"{action} has to wait until the table is loaded")


def open_table(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    options: Mapping[str, str] | None = None,
    described: Mapping[str, dict] | None = None,
    derive: Mapping[str, Column] | None = None,
) -> Table:
    """Open a file or folder as a table.

    Parquet is read where it lies. Other formats carry no row positions, so they are first
    copied to Parquet, each row with the file and block it came from; no shuffle is needed.
    `described` adds labels, lengths and formats; `derive` adds or replaces columns.
    """
    reader = spark.read.options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    frame = reader.format(format).load(path)
    origin = copy = None
    if format != "parquet":
        copy = storage.new_path(spark, "copy")
        publish(with_origin(frame), copy, ROWS_PER_FILE)
        frame, path, origin = spark.read.parquet(copy), copy, (ORIGIN_FILE, ORIGIN_BLOCK)
    table = table_of(spark, path, frame, origin=origin, described=described, derive=derive)
    return replace(table, owned=copy)


def with_origin(frame: DataFrame) -> DataFrame:
    """Add the file and the block of the file each row is read from."""
    return frame.withColumns(
        {
            ORIGIN_FILE: F.col("_metadata.file_path"),
            ORIGIN_BLOCK: F.col("_metadata.file_block_start"),
        }
    )


def table_of(
    spark: SparkSession,
    path: str,
    frame: DataFrame,
    *,
    origin: tuple[str, str] | None = None,
    described: Mapping[str, dict] | None = None,
    derive: Mapping[str, Column] | None = None,
    complete: bool = True,
    expected_rows: int = 0,
    by_arrival: bool = False,
) -> Table:
    """A table over Parquet files already read."""
    stored_number = SOURCE_ROW in frame.columns and bool(
        frame.schema[SOURCE_ROW].metadata.get(NUMBERED)
    )
    own = {*(origin or ()), *((SOURCE_ROW,) if stored_number else ())}
    reserved = {SOURCE_ROW, VIEW_ROW, ORIGIN_FILE, ORIGIN_BLOCK} - own
    if clash := sorted(reserved.intersection(name.lower() for name in frame.columns)):
        raise TableViewError(f"these column names are reserved: {', '.join(clash)}")
    files = None if stored_number else OrderedFiles(spark, frame, origin, by_arrival)
    derive = dict(derive or {})
    visible = [c for c in frame.columns if c not in (SOURCE_ROW, *(origin or ()))]
    shaped = frame.select(
        *[quoted(name) for name in visible if name not in derive],
        *[column.alias(name) for name, column in derive.items()],
    )
    catalog = Catalog.of(shaped.schema, described)
    return Table(spark, path, frame, catalog, files, derive, complete, expected_rows)


def snapshot(table: Table, rows_per_file: int = ROWS_PER_FILE) -> Table:
    """Freeze a cleaned copy that later changes to the source cannot reach.

    The copy stores `_source_row`. It is written without a shuffle into a folder of its own and
    only becomes a table once the write has succeeded; a failed write is removed.
    """
    table.require_complete("a snapshot")
    copy = storage.new_path(table.spark, "snapshot")
    publish(marked(table.with_source_row), copy, rows_per_file)
    described = {v.name: v.field_metadata() for v in table.catalog.variables}
    frozen = table_of(table.spark, copy, table.spark.read.parquet(copy), described=described)
    return replace(frozen, owned=copy)


def marked(frame: DataFrame) -> DataFrame:
    """The frame with its `_source_row` marked as written by this library."""
    return frame.withMetadata(SOURCE_ROW, {NUMBERED: True})


def publish(frame: DataFrame, path: str, rows_per_file: int) -> None:
    """Write a table of the library's own; a failed write leaves nothing behind."""
    spark = frame.sparkSession
    try:
        frame.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    except BaseException:
        storage.delete(spark, path)
        raise
