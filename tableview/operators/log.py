"""The condition log: which condition was applied to which table, newest first.

The operators work on any log frame with a unique, increasing `id`; `ConditionLog` keeps one in
the shared folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableview import storage
from tableview.errors import TableViewError
from tableview.functions.conditions import Condition, from_json, to_json
from tableview.operators.view import View
from tableview.sources.ordered_files import natural_order, scan_tasks, thinned

SCHEMA = (
    "id bigint, dataset_path string, dataset_name string, where_text string, executed_at string"
)

# An entry as it is stored: with its condition, if it was logged as one, to be applied again.
STORED = SCHEMA + ", condition string"

# How many entries are kept, and the bounds that number is kept within.
KEPT_ENTRIES = 500
LEAST_ENTRIES = 10
MOST_ENTRIES = 10_000

# Every character that counts as blank at the ends of a condition.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Ids per window partition. Ids are unique, so no partition can hold more rows than this,
# whatever share of the log one table or one text has.
IDS_PER_GROUP = 1_000_000


# Spark's guess of a frame's size is taken up to here: beyond, it is the product of a join.
MOST_BYTES = 1 << 50


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def kept_entries(wanted: int = KEPT_ENTRIES) -> int:
    return min(max(wanted, LEAST_ENTRIES), MOST_ENTRIES)


def with_previous(
    frame: DataFrame,
    order: str,
    values: Sequence[str],
    within: Sequence[str] = (),
    ids_per_group: int = IDS_PER_GROUP,
) -> DataFrame:
    """Add `_previous`: the values of the row before, by `order`, overall or within a key.

    `order` is a unique whole number. A key of at most `ids_per_group` rows is one window
    partition. The rows of bigger keys, or of the whole log without a key, are windowed in
    groups of consecutive ids; ahead of its first row each group gets one extra row, a copy of
    the last row before the group. Those last rows come from a small aggregation and find their
    own predecessors the same way, in groups of `ids_per_group` again. So the data is shuffled
    once, and neither a global window nor a hot key ever gathers more than `ids_per_group` rows
    in one place.
    """
    keys = list(within)
    rows = frame.withColumn("_row", F.struct(*values)).withColumn("_hot", F.lit(True))
    if keys:
        hot = _hot_keys(frame, keys, ids_per_group)
        if hot is None:
            window = Window.partitionBy(*keys).orderBy(order)
            return rows.withColumn("_previous", F.lag("_row").over(window)).drop("_row", "_hot")
        rows = _marked(rows.drop("_hot"), hot, keys)
    low, high = frame.agg(F.min(order), F.max(order)).first()
    span = 0 if low is None else high - low
    return _lagged(rows, order, keys, ids_per_group, ids_per_group, span).drop("_row", "_hot")


def _hot_keys(frame: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """Keys with more than `most` rows: at most one per `most` rows of the log, so few."""
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counted.filter(F.col("_rows") > most).select(*keys).toArrow()
    return frame.sparkSession.createDataFrame(hot) if hot.num_rows else None


def _marked(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_hot`; a missing key is a key like any other."""
    names = {key: f"_hot_{i}" for i, key in enumerate(keys)}
    marks = hot.withColumnsRenamed(names).withColumn("_hot", F.lit(True))
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]
    joined = rows.join(F.broadcast(marks), same, "left").drop(*names.values())
    return joined.withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def _lagged(
    rows: DataFrame, order: str, within: list[str], width: int, step: int, span: int
) -> DataFrame:
    number = F.col(order)
    if span < width or width > 2**62 // step:
        window = Window.partitionBy(*within, F.lit(0)).orderBy(order)
        return rows.withColumn("_previous", F.lag("_row").over(window))
    group = f"_group_{width}"
    keys = [*within, group]
    first_id = F.when(F.col("_hot"), number - F.pmod(number, F.lit(width)))
    grouped = rows.withColumn(group, first_id)
    last = (
        grouped.filter("_hot")
        .groupBy(*keys)
        .agg(F.max_by("_row", order).alias("_row"))
        .withColumn("_hot", F.lit(True))
    )
    carried = (
        _lagged(last, group, within, width * step, step, span)
        .filter(F.col("_previous").isNotNull())
        .select(*keys, F.col("_previous").alias("_row"), F.lit(True).alias("_extra"))
    )
    both = grouped.withColumn("_extra", F.lit(False)).unionByName(
        carried, allowMissingColumns=True
    )
    # The extra row has no order value, which puts it first.
    window = Window.partitionBy(*keys).orderBy(number.asc_nulls_first())
    previous = both.withColumn("_previous", F.lag("_row").over(window))
    return previous.filter(~F.col("_extra")).drop("_extra", group)


def drop_consecutive(
    log: DataFrame,
    order: str,
    values: Sequence[str],
    within: Sequence[str] = (),
    latest: Sequence | None = None,
    ids_per_group: int = IDS_PER_GROUP,
) -> DataFrame:
    """Keep a row only if its values differ from those of the row before it.

    `latest` are the values the first row is compared with: those of the newest entry already
    in the log.
    """
    previous = with_previous(log, order, values, within, ids_per_group)
    first = F.lit(latest is not None)
    for name, value in zip(values, latest or ()):
        first = first & F.col(name).eqNullSafe(F.lit(value))
    repeated = F.when(F.col("_previous").isNull(), first).otherwise(
        F.col("_previous").eqNullSafe(F.struct(*values))
    )
    return previous.filter(~repeated).drop("_previous")


def cleaned(log: DataFrame, text: str = "where_text") -> DataFrame:
    """Trim the condition texts and drop blank ones."""
    return log.withColumn(text, trimmed(F.col(text))).filter(F.col(text) != "")


def keep_latest(log: DataFrame, order: str = "id", entries: int = KEPT_ENTRIES) -> DataFrame:
    """Only the newest entries: a top-k in levels, no full sort."""
    kept = kept_entries(entries)
    newest = [F.col(order).desc()]
    size = int(str(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = scan_tasks(log.sparkSession, min(size, MOST_BYTES))
    return thinned(log, newest, kept, tasks).orderBy(*newest).limit(kept)


def listed(
    log: DataFrame, order: str = "id", path: str | None = None, path_column: str = "dataset_path"
) -> DataFrame:
    """Newest first, of one table or of all."""
    chosen = log if path is None else log.filter(F.col(path_column) == path)
    return chosen.orderBy(F.col(order).desc())


def without_entries(log: DataFrame, ids: DataFrame, order: str = "id") -> DataFrame:
    """All but the entries whose ids are given as a frame of one column."""
    return log.join(ids.toDF(order), order, "left_anti")


def without_path(
    log: DataFrame, path: str, path_column: str = "dataset_path"
) -> DataFrame:
    """All but one table's entries."""
    return log.filter(F.col(path_column) != path)


class ConditionLog:
    """A log in the shared folder. Each change writes a new version beside the old one.

    A version is current once its write is committed, so a failed change leaves the log as it
    was. Its name holds the highest id ever given: no id is used again, whatever is deleted.
    One writer at a time; the retention keeps every version small.

    An entry logged as a condition, not as its text alone, can be applied again to any table.
    """

    def __init__(self, spark: SparkSession, root: str, entries: int = KEPT_ENTRIES) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.entries = entries

    def _versions(self) -> list[str]:
        committed = [
            path
            for path, _ in storage.list_files(self.spark, self.root)
            if storage.exists(self.spark, path + "/_SUCCESS")
        ]
        return sorted(committed, key=natural_order)

    def read(self) -> DataFrame:
        return self._stored().drop("condition")

    def _stored(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(versions[-1])

    def highest(self) -> int:
        """The highest id ever given, 0 for a new log."""
        versions = self._versions()
        return int(versions[-1].rsplit("-", 1)[-1]) if versions else 0

    def _write(self, log: DataFrame, highest: int | None = None) -> None:
        versions = self._versions()
        number = int(versions[-1].rsplit("-", 2)[-2]) + 1 if versions else 1
        highest = self.highest() if highest is None else highest
        path = f"{self.root}/version-{number}-{highest}"
        log.coalesce(1).write.mode("overwrite").parquet(path)
        for old in versions[:-1]:
            storage.delete(self.spark, old)

    def add(
        self, path: str, applied: str | Condition, when: dt.datetime | None = None
    ) -> int | None:
        """Log one condition, or its text; None if it is blank or repeats the newest entry."""
        written = to_json(applied) if isinstance(applied, Condition) else None
        text = applied.text if isinstance(applied, Condition) else applied
        stripped = text.strip(BLANKS)
        if not stripped:
            return None
        log = self._stored()
        newest = log.orderBy(F.col("id").desc()).limit(1).first()
        if newest is not None and (newest.dataset_path, newest.where_text) == (path, stripped):
            return None
        number = self.highest() + 1
        stamp = (when or dt.datetime.now(dt.UTC)).isoformat(timespec="seconds")
        name = path.rstrip("/").rsplit("/", 1)[-1]
        entry = (number, path, name, stripped, stamp, written)
        entry = self.spark.createDataFrame([entry], STORED)
        self._write(keep_latest(log.unionByName(entry), entries=self.entries), number)
        return number

    def add_all(self, batch: DataFrame) -> None:
        """Log many conditions at once. Their ids must be unique and above every id ever given;
        two aggregations check that first."""
        log, highest = self._stored(), self.highest()
        low, high, rows, ids = batch.agg(
            F.min("id"), F.max("id"), F.count(F.lit(1)), F.countDistinct("id")
        ).first()
        if not rows:
            return
        if low is None or low <= highest or ids != rows:
            raise TableViewError(f"the ids of a batch must be unique and above {highest}")
        newest = log.orderBy(F.col("id").desc()).limit(1).first()
        latest = None if newest is None else (newest.dataset_path, newest.where_text)
        fresh = drop_consecutive(
            cleaned(batch), "id", ["dataset_path", "where_text"], latest=latest
        )
        both = log.unionByName(fresh, allowMissingColumns=True)
        self._write(keep_latest(both, entries=self.entries), high)

    def list(self, path: str | None = None) -> DataFrame:
        return listed(self.read(), path=path)

    def condition(self, entry: int) -> Condition:
        """The condition of an entry, as it was built."""
        row = self._stored().filter(F.col("id") == entry).select("condition").first()
        if row is None or row.condition is None:
            raise TableViewError(f"entry {entry} of the log holds no condition")
        return from_json(row.condition)

    def reapply(self, entry: int, view: View) -> View:
        """The view with the condition of an entry, checked against the view's own table."""
        return view.where(self.condition(entry))

    def delete(self, entry: int) -> None:
        self._write(self._stored().filter(F.col("id") != entry))

    def clear(self, path: str | None = None) -> None:
        log = self._stored()
        self._write(log.filter(F.lit(False)) if path is None else without_path(log, path))
