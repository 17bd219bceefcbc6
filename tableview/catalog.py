"""The variable catalog of a table: what each column is, and how its values are cleaned."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.errors import ColumnSelectionError, ConditionError, TableViewError

SOURCE_ROW = "_source_row"
VIEW_ROW = "_view_row"

CHARACTER = "character"
NUMERIC = "numeric"
TEMPORAL = "temporal"

# Keys of the field metadata that describe a variable.
LABEL_KEY = "label"
LENGTH_KEY = "length"
FORMAT_KEY = "format"

# Storage width in bytes of the types that are not text.
STORAGE_WIDTH = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}

_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return NUMERIC
    if isinstance(data_type, _TEMPORAL):
        return TEMPORAL
    return CHARACTER


def is_finite(column: Column) -> Column:
    """True for a finite number, false for NaN and the infinities, NULL for NULL."""
    return F.abs(column) < F.lit(float("inf"))


def normalized(column: Column, data_type: T.DataType) -> Column:
    """NaN and infinities become NULL, bytes become text, other objects their text."""
    if isinstance(data_type, _FLOATING):
        return F.when(is_finite(column), column)
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(column.cast("string"))
    if isinstance(data_type, T.StringType) or kind_of(data_type) != CHARACTER:
        return column
    return column.cast("string")


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str
    data_type: T.DataType
    label: str = ""
    length: int | None = None
    format: str = ""

    @property
    def raw(self) -> Column:
        return quoted(self.name)

    @property
    def value(self) -> Column:
        """The cleaned value under the variable's own name, its description kept."""
        raw, known = self.raw, self.field_metadata()
        clean = normalized(raw, self.data_type)
        return raw if clean is raw and not known else clean.alias(self.name, metadata=known)

    @property
    def operand(self) -> Column:
        """The value inside a condition.

        Floating columns stay bare, so that a comparison on them still reaches the Parquet
        scan; `valid` is the test that goes with it.
        """
        if isinstance(self.data_type, T.BooleanType):
            return self.raw.cast("int")
        if self.may_be_nonfinite:
            return self.raw
        return normalized(self.raw, self.data_type)

    @property
    def may_be_nonfinite(self) -> bool:
        return isinstance(self.data_type, _FLOATING)

    @property
    def valid(self) -> Column | None:
        return is_finite(self.raw) if self.may_be_nonfinite else None

    def field_metadata(self) -> dict:
        described = {LABEL_KEY: self.label, LENGTH_KEY: self.length, FORMAT_KEY: self.format}
        return {key: value for key, value in described.items() if value not in ("", None)}


class Catalog:
    """The ordered variables of one table."""

    def __init__(self, variables: list[Variable]) -> None:
        if not variables:
            raise TableViewError("the table has no variables")
        self.variables = tuple(variables)
        self._by_name = {variable.name: variable for variable in variables}
        self._by_folded_name = {variable.name.upper(): variable for variable in variables}

    @classmethod
    def of(cls, schema: T.StructType, described: Mapping[str, dict] | None = None) -> Catalog:
        """From a schema and its field metadata; `described` adds to what the fields say."""

        def variable(field: T.StructField) -> Variable:
            known = {**field.metadata, **(described or {}).get(field.name, {})}
            return Variable(
                name=field.name,
                kind=kind_of(field.dataType),
                data_type=field.dataType,
                label=str(known.get(LABEL_KEY, "")),
                length=known.get(LENGTH_KEY),
                format=str(known.get(FORMAT_KEY, "")),
            )

        return cls([variable(field) for field in schema.fields if field.name != SOURCE_ROW])

    @property
    def names(self) -> list[str]:
        return [variable.name for variable in self.variables]

    def find(self, name: str) -> Variable:
        """By name in any case, the way conditions name variables."""
        try:
            return self._by_folded_name[name.upper()]
        except KeyError:
            raise ConditionError(f"the table has no variable {name}") from None

    def exact(self, name: str) -> Variable:
        """By exact name, the way views and sorts name variables."""
        try:
            return self._by_name[name]
        except KeyError:
            raise ColumnSelectionError(f"the table has no variable {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._by_name


def contents(
    spark: SparkSession, frame: DataFrame, catalog: Catalog, search: str = ""
) -> DataFrame:
    """One row per variable: position, name, label, kind, length, format.

    Text without a declared length gets the length of its longest value. Those come from one
    aggregation that reads just these columns; with every length declared nothing is read.
    """
    longest = {
        v.name: F.max(F.length(v.operand))
        for v in catalog.variables
        if v.kind == CHARACTER and v.length is None
    }

    def length(variable: Variable) -> Column:
        if variable.name in longest:
            return quoted(variable.name)
        declared = variable.length or STORAGE_WIDTH.get(variable.data_type.simpleString())
        return F.lit(declared).cast("int")

    measured = (
        frame.agg(*[column.alias(name) for name, column in longest.items()])
        if longest
        else spark.range(1)
    )
    listing = measured.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(position).alias("position"),
                        F.lit(v.name).alias("name"),
                        F.lit(v.label).alias("label"),
                        F.lit(v.kind).alias("kind"),
                        length(v).alias("length"),
                        F.lit(v.format).alias("format"),
                    )
                    for position, v in enumerate(catalog.variables, start=1)
                ]
            )
        )
    )
    needle = search.strip()
    if not needle:
        return listing
    shown_length = F.coalesce(F.col("length").cast("string"), F.lit(""))
    shown = F.concat_ws(" ", "name", "label", "kind", shown_length, "format")
    return listing.filter(F.contains(F.lower(shown), F.lower(F.lit(needle))))
