"""Review large tables with Spark: views, pages, search, export, progressive loading."""

from tableview.catalog import Catalog, Variable
from tableview.errors import (
    ColumnSelectionError,
    ConditionError,
    IncompleteTableError,
    TableViewError,
)
from tableview.functions.conditions import Condition, any_contains, everything, missing, var
from tableview.operators.export import Exported, export_csv
from tableview.operators.log import ConditionLog
from tableview.operators.rebind import Rebound, rebind
from tableview.operators.search import Found, find, find_frame
from tableview.operators.view import Sort, View, page_rows, page_start
from tableview.sources.table import IngestStatus, Table, open_table, snapshot
from tableview.streaming.ingest import Ingest, ingest

__all__ = [
    "Catalog",
    "ColumnSelectionError",
    "Condition",
    "ConditionError",
    "ConditionLog",
    "Exported",
    "Found",
    "IncompleteTableError",
    "Ingest",
    "IngestStatus",
    "Rebound",
    "Sort",
    "Table",
    "TableViewError",
    "Variable",
    "View",
    "any_contains",
    "everything",
    "export_csv",
    "find",
    "find_frame",
    "ingest",
    "missing",
    "open_table",
    "page_rows",
    "page_start",
    "rebind",
    "snapshot",
    "var",
]
