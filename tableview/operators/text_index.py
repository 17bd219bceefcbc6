"""A skip index for searches: which files may show a text.

For each stored file a bitmap tells which strings of one, two and three characters its cells show,
by hash. A text can only be in a file that has all of its strings of three characters (or the text
itself, if it is shorter), so the other files need not be read. A clash of hashes costs a file that
is read for nothing; none is ever missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableview import storage
from tableview.catalog import Variable
from tableview.functions.text import display_text
from tableview.sources.ordered_files import FILE
from tableview.sources.table import ROWS_PER_FILE, publish

LONGEST = 3
#: Bits of a file's bitmap: eight rows of 4 KB.
BITS = 1 << 18
# Beside the variables of a table, none of which is called so.
_FILE = "_origin_file"
#: Fixed value: the bits of one row, as many as Spark's bitmap functions take.
ROW_BITS = 32_768


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    names: tuple[str, ...]

    def files(self, text: str) -> set[str]:
        """The files that may show the text in a cell, in any letter case."""
        lowered = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        size = min(LONGEST, len(lowered))
        grams = {lowered[at : at + size] for at in range(len(lowered) - size + 1)}
        wanted = self.spark.createDataFrame([(gram,) for gram in sorted(grams)], "gram string")
        wanted = wanted.select(_bit(F.col("gram")).alias("bit")).distinct().select(
            _row("bit").alias("row"), _place("bit").alias("place")
        )
        bits = self.spark.read.parquet(self.path)
        byte = F.substring("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))
        shift = F.pow(F.lit(2), F.col("place") % 8).cast("int")
        has = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(shift) != 0
        # As many rows as the text has different strings.
        found = bits.join(F.broadcast(wanted), "row").where(has).groupBy("file")
        listed = found.agg(F.count("*").alias("n")).where(F.col("n") == wanted.count())
        return {row.file for row in listed.select("file").collect()}

    def drop(self) -> None:
        storage.delete(self.spark, self.path)


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("int")


def _row(bit: str) -> Column:
    return F.floor(F.col(bit) / ROW_BITS).cast("int")


def _place(bit: str) -> Column:
    return F.col(bit) % ROW_BITS


def _grams(text: Column) -> Column:
    """All strings of one to `LONGEST` characters, one pass for each length and first place."""
    parts = [
        F.regexp_extract_all(F.substring(text, start + 1, 2**31 - 1), F.lit(f"(?s).{{{size}}}"), F.lit(0))
        for size in range(1, LONGEST + 1)
        for start in range(size)
    ]
    return F.concat(*parts)


def build_text_index(
    frame: DataFrame, variables: list[Variable], shown: dict[str, Column] | None = None
) -> TextIndex:
    """Index the cells of these variables of a frame read from Parquet files; `shown` gives columns
    that are not stored as they are shown.

    Strings are made distinct by file while they are combined in the scan's own tasks, so what is
    shuffled is bounded by the files, not by the rows.
    """
    spark = frame.sparkSession
    cells = [(shown or {}).get(variable.name, variable.raw) for variable in variables]
    frame = frame.select(
        F.col(FILE).alias(_FILE), *[c.alias(v.name) for c, v in zip(cells, variables)]
    )
    strings = F.concat(*[_grams(F.lower(display_text(variable))) for variable in variables])
    grams = frame.select(F.col(_FILE).alias("file"), F.explode(F.array_distinct(strings)).alias("gram"))
    kinds = grams.select("file", _bit(F.col("gram")).alias("bit")).distinct()
    rows = kinds.groupBy("file", _row("bit").alias("row")).agg(
        F.bitmap_construct_agg(_place("bit")).alias("bits")
    )
    path = storage.new_path(spark, "grams")
    publish(rows, path, ROWS_PER_FILE)
    return TextIndex(spark, path, tuple(variable.name for variable in variables))
