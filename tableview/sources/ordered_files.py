"""A dense row number for Parquet files, without a shuffle and without a global window.

Rows are numbered by file, then by position in the file. Files are ordered by path with the
numbers inside the path compared as numbers, so `part-100000` follows `part-99999`. A file's
first number is the row count of the files before it; the counts come from one job that reads
footers only. With a single file there is nothing to count.

What stays on the driver is one small entry per file, as in Spark's own file listing, and
never a row of data.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableview import storage

# Up to this many runs the table of first rows is broadcast with the paths of the files (about
# 200 bytes a run), up to MOST_RUNS with 64-bit hashes of them (about 40 bytes) instead.
BROADCAST_RUNS = 200_000
MOST_RUNS = 5_000_000

# Then it is joined by file and slice, a slice being at most this many rows of one file.
SLICE_ROWS = 5_000_000

# A range of rows is read from the files it lies in by naming them, up to this many names; a
# range over more files reads them all.
NAMED_FILES = 1_000

# The candidates of all tasks of a top-k that may reach the task that picks the result.
TOP_CANDIDATES = 5_000_000

# The most range partitions of one shuffle; a sort that needs more goes in two passes.
SORTED_AT_ONCE = 4_000

# Hidden columns of a Parquet scan: the file a row lies in and its position there.
FILE = "_metadata.file_path"
POSITION = "_metadata.row_index"


@dataclass(frozen=True)
class Run:
    """Consecutive rows of one file: `first` is the number of the row at `position`."""

    file: str
    source: tuple
    position: int
    rows: int
    bytes: int
    written: int = 0
    first: int = 0

    @property
    def end(self) -> int:
        return self.first + self.rows

    def clipped(self, start: int, stop: int) -> Run:
        """Just the rows of the run with start <= number < stop."""
        first = max(self.first, start)
        rows = min(self.end, stop) - first
        position = self.position + first - self.first
        return replace(self, position=position, rows=rows, first=first)


def natural_order(path: str) -> list:
    return [
        (1, int(piece), "") if piece.isdigit() else (0, 0, piece)
        for piece in re.split(r"(\d+)", path)
    ]


class OrderedFiles:
    """Numbers the rows of a Parquet DataFrame.

    `source` optionally names columns holding where each row came from (original file, block):
    then the order is that of the source, and the files are just where the rows lie now. Files
    `by_arrival` are ordered by the time they were written: more files leave the numbers as they
    are.
    """

    def __init__(
        self,
        spark: SparkSession,
        frame: DataFrame,
        source: tuple[str, str] | None = None,
        by_arrival: bool = False,
    ) -> None:
        self.spark = spark
        self.frame = frame
        self.source = source
        self.by_arrival = by_arrival

    @cached_property
    def single_file(self) -> bool:
        return self.source is None and len(self.frame.inputFiles()) == 1

    @cached_property
    def runs(self) -> list[Run]:
        """Every run in row order, from one grouped count over footers (and run columns)."""
        keys = [F.col(name) for name in self.source or ()]
        counted = (
            self.frame.groupBy(F.col(FILE).alias("file"), *keys)
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.max("_metadata.file_size").alias("bytes"),
                F.max(F.unix_micros("_metadata.file_modification_time")).alias("written"),
                *([F.min(F.col(POSITION)).alias("position")] if keys else []),
            )
            .toArrow()
            .to_pylist()
        )
        found = [
            Run(
                file=row["file"],
                source=tuple(row[name] for name in self.source or ()),
                position=row.get("position", 0),
                rows=row["rows"],
                bytes=row["bytes"],
                written=row["written"] if self.by_arrival else 0,
            )
            for row in counted
        ]
        found.sort(key=self._order)
        placed, first = [], 0
        for run in found:
            placed.append(replace(run, first=first))
            first += run.rows
        return placed

    def _order(self, run: Run) -> tuple:
        if not run.source:
            return (run.written, natural_order(run.file))
        file, block = run.source
        return (natural_order(file), block, natural_order(run.file), run.position)

    @property
    def keeps_order(self) -> bool:
        """Numbering leaves the rows where and in the order the scan finds them."""
        return self.source is None and (self.single_file or len(self.runs) <= MOST_RUNS)

    @property
    def total(self) -> int:
        return self.runs[-1].end if self.runs else 0

    @cached_property
    def bytes(self) -> int:
        return sum({run.file: run.bytes for run in self.runs}.values())

    @cached_property
    def _firsts(self) -> list[int]:
        return [run.first for run in self.runs]

    def numbered(self, name: str, base: int = 0, frame: DataFrame | None = None) -> DataFrame:
        """All rows with their number; `base` is the number of the first row.

        `frame` may be the same files read with more columns.
        """
        frame = self.frame if frame is None else frame
        if self.single_file:
            return frame.withColumn(name, F.col(POSITION) + F.lit(base))
        return self.placed(frame, self.runs, name, base)

    def between(
        self, start: int, stop: int, name: str, base: int = 0, only: set[str] | None = None
    ) -> DataFrame:
        """Rows start <= row < stop (counted from 0); only the files that hold them are read, and
        of these just `only`, if given."""
        if self.single_file and (only is None or set(self.frame.inputFiles()) <= only):
            frame = self.frame.filter((F.col(POSITION) >= start) & (F.col(POSITION) < stop))
            return frame.withColumn(name, F.col(POSITION) + F.lit(base))
        runs = [run.clipped(start, stop) for run in self._covering(start, stop, only)]
        if not runs:
            return self.frame.filter(F.lit(False)).withColumn(name, F.lit(0).cast("bigint"))
        frame = self.frame
        files = {run.file for run in runs}
        if len(files) <= NAMED_FILES:
            frame = frame.filter(F.col(FILE).isin(*files))
        return self.placed(frame, runs, name, base, clipped=True)

    def holds(self, start: int, stop: int, only: set[str]) -> bool:
        """Whether any of these files has rows there."""
        return bool(self._covering(start, stop, only))

    def _covering(self, start: int, stop: int, only: set[str] | None = None) -> list[Run]:
        low = max(bisect_right(self._firsts, start) - 1, 0)
        high = bisect_right(self._firsts, stop - 1)
        found = [run for run in self.runs[low:high] if run.end > start]
        return found if only is None else [run for run in found if run.file in only]

    def placed(
        self, frame: DataFrame, runs: list[Run], name: str, base: int, clipped: bool = False
    ) -> DataFrame:
        """Number the rows of `frame` that lie in these runs.

        Where the runs are clipped their bounds travel as columns, not as constants of the
        plan: searches over one range after the other then share their generated code.
        """
        table = pa.table(
            {
                "_run_file": pa.array([run.file for run in runs], pa.string()),
                "_run_shift": pa.array([run.first - run.position + base for run in runs]),
                "_run_start": pa.array([run.position for run in runs], pa.int64()),
                "_run_last": pa.array([run.position + run.rows - 1 for run in runs], pa.int64()),
                **{
                    f"_run_{i}": [run.source[i] for run in runs]
                    for i in range(len(self.source or ()))
                },
            }
        )
        shifts = self.spark.createDataFrame(table)
        located = frame.withColumns({"_run_file": F.col(FILE), "_run_position": F.col(POSITION)})
        keys = ["_run_file"]
        for i, column in enumerate(self.source or ()):
            located = located.withColumn(f"_run_{i}", F.col(column))
            keys.append(f"_run_{i}")
        if len(runs) <= BROADCAST_RUNS:
            joined = located.join(F.broadcast(shifts), keys)
        elif len(runs) <= MOST_RUNS and (hashed := _hashed(shifts, keys)) is not None:
            located = located.withColumns({key: F.xxhash64(key) for key in keys if key in PATHS})
            joined = located.join(F.broadcast(hashed), keys)
        else:
            joined = _sliced_join(located, shifts, keys)
        if clipped:
            position = F.col("_run_position")
            joined = joined.filter(position.between(F.col("_run_start"), F.col("_run_last")))
        numbered = joined.withColumn(name, F.col("_run_position") + F.col("_run_shift"))
        return numbered.drop(*keys, "_run_position", "_run_shift", "_run_start", "_run_last")


#: Keys of runs that are paths.
PATHS = ("_run_file", "_run_0")


def _hashed(shifts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The runs with hashes in place of paths; None if two paths have the same hash."""
    paths = [key for key in keys if key in PATHS]
    for path in paths:
        counted = shifts.agg(F.countDistinct(path), F.countDistinct(F.xxhash64(path))).first()
        if counted[0] != counted[1]:
            return None
    return shifts.withColumns({path: F.xxhash64(path) for path in paths})


def _sliced_join(located: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """The join by file for very many files. No key has more than SLICE_ROWS rows."""

    def slice_of(position: str) -> Column:
        return F.floor(F.col(position) / SLICE_ROWS)

    slices = F.explode(F.sequence(slice_of("_run_start"), slice_of("_run_last")))
    return (
        located.withColumn("_run_slice", slice_of("_run_position"))
        .join(shifts.withColumn("_run_slice", slices), [*keys, "_run_slice"])
        .drop("_run_slice")
    )


def scan_tasks(spark: SparkSession, size: int, files: int = 1) -> int:
    """About as many tasks as Spark scans so many bytes in so many files with."""
    split = _bytes(spark, "spark.sql.files.maxPartitionBytes")
    opening = _bytes(spark, "spark.sql.files.openCostInBytes")
    return max(1, -(-(size + files * opening) // split))


def _bytes(spark: SparkSession, name: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def thinned(frame: DataFrame, order: list[Column], rows: int, tasks: int) -> DataFrame:
    """What may be among the first `rows` rows, few enough for one task to pick them.

    Every task keeps its own first rows, so the scan stays as wide as it is. While there are too
    many tasks for one to take over from all, they hand their rows to fewer, evenly, and those keep
    their first ones again: no task is given more than TOP_CANDIDATES rows (or two tasks' rows).
    """
    fan_in = max(2, TOP_CANDIDATES // max(rows, 1))
    # Rows in a sorted partition are numbered 0, 1, 2, ... below the number of the partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        frame = frame.sortWithinPartitions(*order).filter(place < rows).repartition(tasks)
    return frame


def partition_count(spark: SparkSession, source_bytes: int) -> int:
    """Sort partitions for this much Parquet: the session's own number, or more if it is big."""
    per_partition = 512 * 1024 * 1024
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-source_bytes // per_partition))


def sorted_rows(frame: DataFrame, order: list[Column], source_bytes: int) -> DataFrame:
    """A total order over partitions.

    While the session's partition number is enough this is a plain ORDER BY, which adaptive
    execution may merge into fewer partitions; beyond it the range partitions are sized to the
    data, up to SORTED_AT_ONCE. The order must end in a unique column, so that one sort value never
    fills a partition.
    """
    spark = frame.sparkSession
    wanted = min(partition_count(spark, source_bytes), SORTED_AT_ONCE)
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return frame.orderBy(*order)
    return frame.repartitionByRange(wanted, *order).sortWithinPartitions(*order)


def sorted_parts(
    frame: DataFrame, order: list[Column], source_bytes: int
) -> Iterator[DataFrame]:
    """The rows in order, as frames that follow each other, each in a total order of its own.

    Usually that is one frame. A table that takes more than SORTED_AT_ONCE partitions is sorted in
    two passes: it is dealt to coarse ranges, about the square root of the partitions, by splitters
    that Spark samples, and written once; each range is then sorted by itself. The blocks that tasks
    exchange so grow with n ** 1.5 instead of n ** 2. A range is deleted once the next is asked for.
    """
    spark = frame.sparkSession
    wanted = partition_count(spark, source_bytes)
    if wanted <= SORTED_AT_ONCE:
        yield sorted_rows(frame, order, source_bytes)
        return
    folder = storage.new_path(spark, "dealt")
    try:
        dealt = frame.repartitionByRange(math.isqrt(wanted - 1) + 1, *order)
        # Only passed on, not sorted: a task writes its range as it arrives, in files of their own.
        dealt.write.option("maxRecordsPerFile", SLICE_ROWS).parquet(folder)
        ranges: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for path, size in storage.list_files(spark, folder):
            if (name := re.match(r"part-\d+", path.rsplit("/", 1)[-1])) is not None:
                ranges[name[0]].append((path, size))
        for name in sorted(ranges, key=natural_order):
            paths = [path for path, _ in ranges[name]]
            part = spark.read.schema(frame.schema).parquet(*paths)
            yield sorted_rows(part, order, sum(size for _, size in ranges[name]))
            for path in paths:
                storage.delete(spark, path)
    finally:
        storage.delete(spark, folder)
