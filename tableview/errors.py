"""Errors raised before any Spark job starts."""


class TableViewError(ValueError):
    """Base of every error a caller can correct."""


class ConditionError(TableViewError):
    """A condition does not fit the variables of the table."""


class ColumnSelectionError(TableViewError):
    """A view or sort names no variable, or one the table does not have."""


class IncompleteTableError(TableViewError):
    """The table is still loading; only browsing is allowed."""
