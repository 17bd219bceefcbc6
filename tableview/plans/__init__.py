"""Every registered query with the SQL it must agree with."""

from tableview.plans import conditions, logs, tables, views

ALL = {**tables.QUERIES, **views.QUERIES, **conditions.QUERIES, **logs.QUERIES}
