"""A registered query: how to run it on the given tables, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tableview.operators.view import View
from tableview.sources.table import Table, open_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def opened(spark: SparkSession, folder: str, name: str, **options) -> Table:
    return open_table(spark, f"{folder}/{name}.parquet", **options)


def view(spark: SparkSession, folder: str, name: str, **options) -> View:
    return View.of(opened(spark, folder, name, **options))
