"""Carry a view over to a new version of its table."""

from __future__ import annotations

from dataclasses import dataclass

from tableview.errors import ConditionError
from tableview.functions.conditions import Condition
from tableview.operators.view import View
from tableview.sources.table import Table


@dataclass(frozen=True)
class Rebound:
    """The new view, why its condition was dropped (if it was), and a condition still to come."""

    view: View
    warning: str = ""
    pending: Condition | None = None

    def resume(self) -> Rebound:
        """Apply the pending condition once the new table has finished loading."""
        return self if self.pending is None else _apply(self.view, self.pending)


def rebind(view: View, table: Table) -> Rebound:
    """Keep what still fits the new table.

    Surviving columns keep their order. The sort stays if its variable is still visible and the
    table is complete. The condition is checked against the new catalog and applied, dropped
    with a warning if it no longer fits, or left pending while the table is still loading. The
    old view is untouched.
    """
    visible = tuple(name for name in view.columns if name in table.catalog)
    kept = View(table, visible)
    if not table.complete:
        return Rebound(kept, pending=view.condition)
    if view.sort is not None and view.sort.variable in visible:
        kept = kept.sort_by(view.sort.variable, view.sort.ascending)
    return Rebound(kept) if view.condition is None else _apply(kept, view.condition)


def _apply(view: View, condition: Condition) -> Rebound:
    try:
        return Rebound(view.where(condition))
    except ConditionError as error:
        return Rebound(view, f"the condition no longer fits the table and was dropped: {error}")
