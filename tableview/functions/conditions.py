"""Row conditions: comparisons, prefixes, lists, ranges, text tests, missing values, logic.

    (var("AESER") == "Y") & (var("AGE") >= 40)

A condition knows nothing about a table until it meets a catalog. It is then checked and
becomes one of two columns: `passes`, true for the rows it keeps, and `fails`, true for the
rows its negation keeps. A row that is neither (a comparison with a missing value) is dropped
by both, which is SQL's three-valued logic seen from inside a filter. Negation swaps the two
and AND/OR follow De Morgan, so no NOT is left around a comparison and every comparison on a
stored column, negated or not, can be pushed into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import CHARACTER, NUMERIC, TEMPORAL, Catalog, Variable, is_finite
from tableview.errors import ConditionError
from tableview.functions.text import any_text_contains

ColumnBuilder = Callable[[Catalog], Column]

# The six comparisons, their Python operator and their opposite.
COMPARISONS = {
    "=": (operator.eq, "!="),
    "!=": (operator.ne, "="),
    ">": (operator.gt, "<="),
    ">=": (operator.ge, "<"),
    "<": (operator.lt, ">="),
    "<=": (operator.le, ">"),
}

# A character that stands for "no escape": LIKE must not treat a backslash specially.
NO_ESCAPE = "\x01"

_INT64 = range(-(2**63), 2**63)


@dataclass(frozen=True)
class Condition:
    passes: ColumnBuilder
    fails: ColumnBuilder
    text: str
    # What it was built from: an operation and its arguments, to be written down and built again.
    tree: tuple = ("everything",)

    def column(self, catalog: Catalog) -> Column:
        """The filter column; raises ConditionError if the condition does not fit."""
        return self.passes(catalog)

    def __and__(self, other: Condition) -> Condition:
        return Condition(
            lambda c: self.passes(c) & other.passes(c),
            lambda c: self.fails(c) | other.fails(c),
            f"({self.text}) AND ({other.text})",
            ("and", self, other),
        )

    def __or__(self, other: Condition) -> Condition:
        return Condition(
            lambda c: self.passes(c) | other.passes(c),
            lambda c: self.fails(c) & other.fails(c),
            f"({self.text}) OR ({other.text})",
            ("or", self, other),
        )

    def __invert__(self) -> Condition:
        return Condition(self.fails, self.passes, f"NOT ({self.text})", ("not", self))

    def __bool__(self) -> bool:
        raise TypeError("join conditions with & | ~, each in its own parentheses")


def everything() -> Condition:
    """The empty condition: every row passes."""
    return Condition(lambda c: F.lit(True), lambda c: F.lit(False), "")


def missing(name: str) -> Condition:
    return var(name).is_missing()


def any_contains(names: list[str], text: str) -> Condition:
    """Any of the variables shows the text, in any letter case."""

    def found(catalog: Catalog) -> Column:
        return any_text_contains([catalog.find(name) for name in names], text)

    shown = f"ANY({', '.join(names)}) ? {_shown(text)}"
    return Condition(found, lambda c: ~found(c), shown, ("any", list(names), text))


class Var:
    """A variable named in a condition; names match in any letter case."""

    __hash__ = None

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, other) -> Condition:
        return _comparison(self, "=", other)

    def __ne__(self, other) -> Condition:
        return _comparison(self, "!=", other)

    def __gt__(self, other) -> Condition:
        return _comparison(self, ">", other)

    def __ge__(self, other) -> Condition:
        return _comparison(self, ">=", other)

    def __lt__(self, other) -> Condition:
        return _comparison(self, "<", other)

    def __le__(self, other) -> Condition:
        return _comparison(self, "<=", other)

    def prefix(self, comparison: str, other) -> Condition:
        """Compare just the leading characters; a missing value acts as empty text."""
        return _prefix(self, comparison, other)

    def starts_with(self, other) -> Condition:
        return _prefix(self, "=", other)

    def is_in(self, *values) -> Condition:
        return _membership(self, values)

    def not_in(self, *values) -> Condition:
        return ~_membership(self, values)

    def between(self, low, high) -> Condition:
        return _between(self, low, high)

    def not_between(self, low, high) -> Condition:
        return ~_between(self, low, high)

    def contains(self, other) -> Condition:
        """Case-sensitive substring; a missing value acts as empty text."""
        return _contains(self, other)

    def not_contains(self, other) -> Condition:
        return ~_contains(self, other)

    def like(self, pattern: str, escape: str | None = None) -> Condition:
        """`%` any run, `_` any character, no escape character unless given."""
        return _like(self, pattern, escape)

    def not_like(self, pattern: str, escape: str | None = None) -> Condition:
        return ~_like(self, pattern, escape)

    def is_missing(self) -> Condition:
        """Text: NULL or empty. Everything else: NULL (or a non-finite number)."""
        return _missing(self)

    def is_not_missing(self) -> Condition:
        return ~_missing(self)


def var(name: str) -> Var:
    return Var(name)


# ---- checking against the catalog -------------------------------------------------------


def _literal(variable: Variable, value) -> Column:
    if variable.kind == NUMERIC:
        if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)):
            raise ConditionError(f"{variable.name} is numeric, {value!r} is not a number")
        if not isinstance(value, int) and not math.isfinite(value):
            raise ConditionError(f"{variable.name} needs a finite number")
        if isinstance(value, int) and value not in _INT64:
            raise ConditionError(f"{value} does not fit into 64 bits")
        if isinstance(variable.data_type, T.DecimalType) and not isinstance(value, int):
            # As a decimal, so that the comparison with the stored column is pushed down.
            return F.lit(value if isinstance(value, decimal.Decimal) else decimal.Decimal(repr(value)))
        if isinstance(value, decimal.Decimal) and isinstance(
            variable.data_type, (T.FloatType, T.DoubleType)
        ):
            return F.lit(float(value))
        whole = isinstance(variable.data_type, T.IntegralType) and value == int(value)
        # A whole number as such, so that a comparison with a stored integer is pushed down.
        return F.lit(int(value)) if whole and int(value) in _INT64 else F.lit(value)
    if variable.kind == TEMPORAL:
        if not isinstance(value, dt.date):
            raise ConditionError(f"{variable.name} is temporal, {value!r} is no date or time")
        timed = isinstance(value, dt.datetime) and value.time() != dt.time()
        if isinstance(variable.data_type, T.DateType) and timed:
            raise ConditionError(f"{variable.name} holds dates, {value!r} has a time of day")
        # As text, which no time zone of the Python process can shift.
        return F.lit(value.isoformat()).cast(variable.data_type)
    if not isinstance(value, str):
        raise ConditionError(f"{variable.name} is character, {value!r} is not text")
    return F.lit(value)


def _operand(left: Variable, other, catalog: Catalog) -> tuple[Column, Column | None]:
    """The right side of a test and, for a column that may be non-finite, its validity."""
    if not isinstance(other, Var):
        return _literal(left, other), None
    right = catalog.find(other.name)
    if right.kind != left.kind:
        raise ConditionError(
            f"{left.name} is {left.kind} and {right.name} is {right.kind}: they do not go together"
        )
    return right.operand, right.valid


def _character(catalog: Catalog, name: str, test: str) -> Variable:
    variable = catalog.find(name)
    if variable.kind != CHARACTER:
        raise ConditionError(f"{test} needs a character variable, {variable.name} is none")
    return variable


def _guarded(test: Column, *valid: Column | None) -> Column:
    return reduce(operator.and_, [check for check in valid if check is not None], test)


def _or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


# ---- the tests --------------------------------------------------------------------------


def _comparison(left: Var, comparison: str, other) -> Condition:
    compare, opposite = COMPARISONS[comparison]

    def built(catalog: Catalog, test) -> Column:
        variable = catalog.find(left.name)
        value, valid = _operand(variable, other, catalog)
        return _guarded(test(variable.operand, value), variable.valid, valid)

    return Condition(
        lambda c: built(c, compare),
        lambda c: built(c, COMPARISONS[opposite][0]),
        f"{left.name} {comparison} {_shown(other)}",
        ("compare", left, comparison, other),
    )


def _prefix(left: Var, comparison: str, other) -> Condition:
    def built(catalog: Catalog, comparison: str) -> Column:
        variable = _character(catalog, left.name, "a prefix comparison")
        value, _ = _operand(variable, other, catalog)
        if isinstance(other, Var):
            first, second = _or_empty(variable.operand), _or_empty(value)
            shared = F.least(F.length(first), F.length(second))
            compare = COMPARISONS[comparison][0]
            return compare(F.left(first, shared), F.left(second, shared))
        if other == "":
            raise ConditionError("a prefix comparison needs a non-empty prefix")
        return _leading(variable.operand, comparison, other)

    # A missing value is empty text here, so that each comparison or its opposite holds.
    opposite = COMPARISONS[comparison][1]
    return Condition(
        lambda c: built(c, comparison),
        lambda c: built(c, opposite),
        f"{left.name} {comparison}: {_shown(other)}",
        ("prefix", left, comparison, other),
    )


def _leading(column: Column, comparison: str, prefix: str) -> Column:
    """The comparison of the leading characters as ranges of the whole text, which reach the scan.

    All texts with the prefix lie from the prefix itself up to, but without, its successor.
    """
    after = successor(prefix)
    absent, below = column.isNull(), column < F.lit(prefix)
    beyond = F.lit(False) if after is None else column.isNotNull() & (column >= F.lit(after))
    if comparison == "=":
        return column.isNotNull() & column.startswith(prefix)
    if comparison == ">=":
        return column.isNotNull() & (column >= F.lit(prefix))
    if comparison == "<":
        return absent | below
    if comparison == ">":
        return beyond
    if comparison == "!=":
        return absent | below | beyond
    return F.lit(True) if after is None else absent | (column < F.lit(after))


def successor(prefix: str) -> str | None:
    """The smallest text after all texts with the prefix, by code points; None if there is none."""
    kept = prefix.rstrip("\U0010ffff")
    if not kept:
        return None
    last = ord(kept[-1])
    # Surrogates are no characters.
    following = 0xE000 if last == 0xD7FF else last + 1
    return kept[:-1] + chr(following)


def _membership(left: Var, values: tuple) -> Condition:
    if not values:
        raise ConditionError("a list of values cannot be empty")

    def built(catalog: Catalog, negated: bool) -> Column:
        variable = catalog.find(left.name)
        test = variable.operand.isin(*[_literal(variable, value) for value in values])
        return _guarded(~test if negated else test, variable.valid)

    listed = ", ".join(_shown(value) for value in values)
    return Condition(
        lambda c: built(c, False),
        lambda c: built(c, True),
        f"{left.name} IN ({listed})",
        ("in", left, list(values)),
    )


def _between(left: Var, low, high) -> Condition:
    inside = _comparison(left, ">=", low) & _comparison(left, "<=", high)
    text = f"{left.name} BETWEEN {_shown(low)} AND {_shown(high)}"
    return Condition(inside.passes, inside.fails, text, ("between", left, low, high))


def _contains(left: Var, other) -> Condition:
    def built(catalog: Catalog) -> Column:
        variable = _character(catalog, left.name, "CONTAINS")
        needle, _ = _operand(variable, other, catalog)
        if isinstance(other, Var):
            return F.contains(_or_empty(variable.operand), _or_empty(needle))
        if other == "":
            return F.lit(True)
        return variable.operand.isNotNull() & F.contains(variable.operand, needle)

    shown = f"{left.name} CONTAINS {_shown(other)}"
    return Condition(built, lambda c: ~built(c), shown, ("contains", left, other))


def _like(left: Var, pattern: str, escape: str | None) -> Condition:
    if escape is not None and len(escape) != 1:
        raise ConditionError("the escape is exactly one character")

    def built(catalog: Catalog) -> Column:
        variable = _character(catalog, left.name, "LIKE")
        wanted = _like_pattern(pattern, escape)
        _literal(variable, pattern)
        if wanted is None:
            return F.when(variable.operand.isNotNull(), F.lit(False))
        return F.like(variable.operand, F.lit(wanted), F.lit(escape or NO_ESCAPE))

    shown_escape = "" if escape is None else f" ESCAPE {_shown(escape)}"
    return Condition(
        built,
        lambda c: ~built(c),
        f"{left.name} LIKE {_shown(pattern)}{shown_escape}",
        ("like", left, pattern, escape),
    )


def _like_pattern(pattern: str, escape: str | None) -> str | None:
    """The pattern in Spark's terms; None if it ends in a lone escape and can match nothing.

    Spark accepts an escape just before `%`, `_` or itself. Elsewhere it simply makes the next
    character literal, so it can go.
    """
    if escape is None or not isinstance(pattern, str):
        return pattern
    characters = iter(pattern)
    kept = []
    for character in characters:
        if character != escape:
            kept.append(character)
            continue
        following = next(characters, None)
        if following is None:
            return None
        kept.append(escape + following if following in ("%", "_", escape) else following)
    return "".join(kept)


def _missing(left: Var) -> Condition:
    def absent(catalog: Catalog) -> Column:
        variable = catalog.find(left.name)
        if variable.kind == CHARACTER:
            return variable.operand.isNull() | (variable.operand == "")
        if variable.may_be_nonfinite:
            return variable.raw.isNull() | ~is_finite(variable.raw)
        return variable.operand.isNull()

    def present(catalog: Catalog) -> Column:
        variable = catalog.find(left.name)
        filled = variable.operand.isNotNull()
        if variable.kind == CHARACTER:
            return filled & (variable.operand != "")
        return _guarded(filled, variable.valid)

    return Condition(absent, present, f"MISSING({left.name})", ("missing", left))


# ---- conditions written down and built again ----------------------------------------------

# Fixed value: how conditions are written; other versions are refused.
VERSION = 1

# How values are written that JSON has no exact form for.
WRITTEN = {
    "number": (float, repr, float),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
    "time": (dt.datetime, dt.datetime.isoformat, dt.datetime.fromisoformat),
    "date": (dt.date, dt.date.isoformat, dt.date.fromisoformat),
}

BUILDERS = {
    "everything": everything,
    "and": operator.and_,
    "or": operator.or_,
    "not": operator.invert,
    "any": any_contains,
    "compare": _comparison,
    "prefix": _prefix,
    "in": lambda left, values: _membership(left, tuple(values)),
    "between": _between,
    "contains": _contains,
    "like": _like,
    "missing": _missing,
}


def to_json(condition: Condition) -> str:
    """The condition as text from which `from_json` builds it again, on any table."""
    return json.dumps({"version": VERSION, "condition": _written(condition)}, ensure_ascii=False)


def from_json(text: str) -> Condition:
    try:
        known = json.loads(text)
        if known["version"] != VERSION:
            raise ConditionError(f"a condition of version {known['version']} cannot be read")
        return _built(known["condition"])
    except (KeyError, TypeError, ValueError, RecursionError) as error:
        raise ConditionError(f"this is no written condition: {error}") from None


def _written(value):
    if isinstance(value, Condition):
        return {"is": value.tree[0], "of": [_written(part) for part in value.tree[1:]]}
    if isinstance(value, Var):
        return {"var": value.name}
    if isinstance(value, list):
        return [_written(part) for part in value]
    if value is None or isinstance(value, (str, bool, int)):
        return value
    for name, (kind, write, _) in WRITTEN.items():
        if isinstance(value, kind):
            return {name: write(value)}
    raise ConditionError(f"{value!r} cannot be written down")


def _built(value):
    if isinstance(value, list):
        return [_built(part) for part in value]
    if not isinstance(value, dict):
        return value
    if "is" in value:
        return BUILDERS[value["is"]](*[_built(part) for part in value["of"]])
    if "var" in value:
        return var(value["var"])
    ((name, text),) = value.items()
    return WRITTEN[name][2](text)


# ---- the condition as text, for the log -------------------------------------------------


def _shown(value) -> str:
    if isinstance(value, Var):
        return value.name
    if isinstance(value, str):
        return '"' + value.replace('"', '""') + '"'
    return str(value)
