"""Export the current view to CSV: its rows, its columns, its order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tableview import storage
from tableview.functions.text import BOM, csv_header, csv_line
from tableview.operators.view import View
from tableview.sources.ordered_files import natural_order

# Names every file of an export in order, the header first.
ORDER = "_order"


@dataclass(frozen=True)
class Exported:
    rows: int
    path: str
    single_file: bool


def export_csv(view: View, destination: str, *, single_file: bool = False) -> Exported:
    """Write the view as UTF-8 CSV with a byte-order mark and a header.

    Executors format and write the lines of the sorted partitions in parallel. The result is the
    folder `<destination>.parts`: the file `_order` names a header and the parts in order, one a
    line; joined so they are one CSV file. A new export writes its files beside those of the one
    before. `_order` is renamed into place when they are whole, and only then the earlier ones go,
    so a failed export leaves the one before as it was. With `single_file` the parts are joined
    here, as a stream inside the JVM, into one file that appears under its name only when complete.
    """
    view.table.require_complete("exporting")
    columns = view._visible()
    spark = view.table.spark
    if not destination.lower().endswith(".csv"):
        destination += ".csv"
    folder = storage.new_path(spark, "export") if single_file else destination + ".parts"
    header = BOM + csv_header(list(columns)).encode() + b"\n"
    before = _names(spark, folder)
    try:
        rows, parts = _written_parts(view, folder)
        if single_file:
            files = [f"{folder}/{name}" for name in parts]
            storage.concatenate(spark, header, files, destination)
            storage.delete(spark, folder)
            return Exported(rows, destination, True)
        first = f"header-{uuid.uuid4().hex}.csv"
        storage.write_bytes(spark, f"{folder}/{first}", header)
        listed = "".join(f"{name}\n" for name in (first, *parts)).encode()
        storage.replace_bytes(spark, f"{folder}/{ORDER}", listed)
    except BaseException:
        for name in _names(spark, folder) - before:
            storage.delete(spark, f"{folder}/{name}")
        if not before:
            storage.delete(spark, folder)
        raise
    for name in before - {ORDER}:
        storage.delete(spark, f"{folder}/{name}")
    return Exported(rows, folder, False)


def exported_parts(spark: SparkSession, path: str) -> list[str]:
    """The files of an export in parts, in order."""
    return [f"{path}/{name}" for name in storage.read_text(spark, f"{path}/{ORDER}").split("\n")[:-1]]


def _names(spark: SparkSession, folder: str) -> set[str]:
    return {path.rsplit("/", 1)[-1] for path, _ in storage.list_files(spark, folder)}


def _written_parts(view: View, folder: str) -> tuple[int, list[str]]:
    """Add the lines of the view to the folder; their number, and the new files in order."""
    spark = view.table.spark
    variables = [view.table.catalog.exact(name) for name in view.columns]
    rows, parts, there = 0, [], _names(spark, folder)
    for number, ordered in enumerate(view.ordered_parts()):
        observed = Observation(f"export-{number}")
        lines = ordered.select(csv_line(variables).alias("line"))
        counted = lines.observe(observed, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("append").text(folder)
        rows += observed.get["rows"]
        new = {name for name in _names(spark, folder) - there if name.startswith("part-")}
        parts += sorted(new, key=natural_order)
        there |= new
    return rows, parts
