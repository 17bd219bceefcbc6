"""Values as text: what a cell shows, what find searches, and what a CSV line holds."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import CHARACTER, NUMERIC, TEMPORAL, Variable, normalized

# The characters that numbers, and dates and times, are written with.
KIND_CHARACTERS = {NUMERIC: "0123456789+-.e", TEMPORAL: "0123456789+-.: "}

BOM = b"\xef\xbb\xbf"


def number_text(column: Column) -> Column:
    """A double in its shortest form: 45.0, 0.3, 123456789.0, 1e-05, 1e+16.

    Plain decimals from 1e-4 up to below 1e16, an exponent of at least two digits elsewhere.
    Spark's own text is already that from 1e-3 up to below 1e7, which is where most values
    lie. The rest is one body over an array of one value: it stands in the plan once, however long
    the column's own expression is, and adds nothing to the generated code.
    """
    column = column.cast("double")
    size = F.abs(column)
    given = F.struct(column.alias("value"), column.cast("string").alias("own"))
    other = F.element_at(F.transform(F.array(given), _unusual_text), 1)
    usual = size.between(1e-3, 9999999.999999998) | (size == 0)
    return F.when(usual, column.cast("string")).when(column.isNotNull(), other)


def _unusual_text(given: Column) -> Column:
    """The text of a number outside the range that Spark prints plainly."""
    column, own = given["value"], given["own"]
    size = F.abs(column)
    # 17 digits before and 21 after the point hold the text of every double of this range.
    digits = F.rtrim(own.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.regexp_replace(digits, r"\.$", ".0")
    # From 1e16 on older Java versions may print digits too many: the shortest text of 15 to 17
    # digits that reads back is taken, up to 9e18 from the whole number itself.
    sixteen, seventeen = F.format_string("%.15e", column), F.format_string("%.16e", column)
    long = (size >= 9e18) & (F.length(own) > 20)
    shortest = (
        F.when((size >= 1e16) & (size < 9e18), _whole_digits(column))
        .when(long & (sixteen.try_cast("double") == column), sixteen)
        .when(long & (seventeen.try_cast("double") == column), seventeen)
        .otherwise(own)
    )
    bare = F.regexp_replace(shortest, r"\.?0*[eE]\+?", "e")
    signed = F.regexp_replace(bare, r"e(\d)", "e+$1")
    scientific = F.regexp_replace(signed, r"([+-])(\d)$", "$10$2")
    return F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)


def _whole_digits(column: Column) -> Column:
    """A double from 1e16 up to below 9e18 with an exponent, rounded to as few of its digits, 15
    at least, as read back the same."""
    size = F.abs(column)
    whole = size.try_cast("bigint")
    step = F.when(size < 1e17, F.lit(100)).when(size < 1e18, F.lit(1_000)).otherwise(10_000)

    def rounded(unit: Column) -> Column:
        half = F.floor(unit / 2)
        return whole + half - F.pmod(whole + half, unit)

    fifteen, sixteen, seventeen = (rounded(F.floor(step / part)) for part in (1, 10, 100))
    chosen = (
        F.when(fifteen.cast("double") == size, fifteen)
        .when(sixteen.cast("double") == size, sixteen)
        .otherwise(seventeen)
        .cast("string")
    )
    digits = F.concat(F.substring(chosen, 1, 1), F.lit("."), F.substring(chosen, 2, 20))
    exponent = F.concat(F.lit("e"), (F.length(chosen) - 1).cast("string"))
    return F.concat(F.when(column < 0, "-").otherwise(""), digits, exponent)


def value_text(column: Column, data_type: T.DataType) -> Column:
    """A value as text, NULL for a missing one."""
    clean = normalized(column, data_type)
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.BooleanType)):
        return number_text(clean)
    return clean if isinstance(data_type, T.StringType) else clean.cast("string")


def display_text(variable: Variable, missing: str = "") -> Column:
    """The text a cell shows, with a marker of the caller's choice for a missing value."""
    return F.coalesce(value_text(variable.raw, variable.data_type), F.lit(missing))


def shows(variable: Variable, text: str) -> Column:
    """The variable's text contains the given text, in any letter case.

    A number or a date never shows a letter, so most searches need not turn them into text.
    """
    characters = KIND_CHARACTERS.get(variable.kind)
    if characters is not None and not set(text.lower()) <= set(characters):
        return F.lit(False)
    shown = display_text(variable)
    if variable.kind == CHARACTER or isinstance(variable.data_type, T.DecimalType):
        shown = F.lower(shown)
    return F.contains(shown, F.lower(F.lit(text)))


def any_text_contains(variables: list[Variable], text: str) -> Column:
    return reduce(operator.or_, [shows(variable, text) for variable in variables])


# ---- CSV lines --------------------------------------------------------------------------


def csv_field(text: Column) -> Column:
    """Quoted just when it holds a comma, a quote or a line break; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[,"\\r\\n]')), quoted).otherwise(text)


def csv_line(variables: list[Variable]) -> Column:
    """One CSV record. A record of one empty field is `""`, so that it stays a line."""
    fields = [csv_field(display_text(variable)) for variable in variables]
    if len(fields) == 1:
        return F.when(fields[0] == "", F.lit('""')).otherwise(fields[0])
    return F.concat_ws(",", *fields)


def csv_header(names: list[str]) -> str:
    def field(name: str) -> str:
        special = any(mark in name for mark in ',"\r\n')
        return '"' + name.replace('"', '""') + '"' if special else name

    return ",".join(field(name) for name in names)
