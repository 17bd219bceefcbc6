"""Queries on the condition log; the given event table serves as a log.

Its event id is the entry id, the user the table a condition belongs to, the type its text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tableview import storage
from tableview.catalog import SOURCE_ROW
from tableview.functions.conditions import var
from tableview.operators import log
from tableview.plans.registry import Query, opened, view

_ENTRY = "event_id AS id, user_id AS dataset_path, event_type AS where_text"


def entries(spark, folder):
    return opened(spark, folder, "events").unnumbered.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("dataset_path"),
        F.col("event_type").alias("where_text"),
    )


def untidy(spark, folder):
    """Blank texts and texts with blanks around them, all of one table."""
    text = F.col("where_text")
    return entries(spark, folder).withColumns(
        {
            "where_text": F.when(text == "error", F.lit(" \t "))
            .when(text == "view", F.lit("\n click  "))
            .otherwise(text),
            "dataset_path": F.col("dataset_path") % 2,
        }
    )


def _deduped(within: str) -> str:
    values = "where_text" if within else "(dataset_path, where_text)"
    return f"""
SELECT id, dataset_path, where_text FROM (
  SELECT *, lag(id) OVER w AS before, lag(where_text) OVER w AS text_before,
         lag(dataset_path) OVER w AS path_before
  FROM (SELECT {_ENTRY} FROM events) AS e
  WINDOW w AS ({within} ORDER BY id)
) AS l
WHERE before IS NULL OR text_before IS DISTINCT FROM where_text
   OR path_before IS DISTINCT FROM dataset_path"""


def reapplied(spark, folder):
    """A condition is logged with another table, read from the log and applied to the orders."""
    kept = log.ConditionLog(spark, storage.new_path(spark, "log"))
    cheap = var("O_TOTALPRICE").between(1000, 150000.5) & ~var("o_orderstatus").is_in("F", "P")
    number = kept.add("/old/orders", cheap | var("o_orderpriority").prefix(">=", "5"))
    kept.add("/old/orders", "typed by hand")
    shown = kept.reapply(number, view(spark, folder, "orders"))
    return shown.select("o_orderkey", "o_totalprice").rows().drop(SOURCE_ROW)


QUERIES = {
    "log_reapply": Query(
        reapplied,
        """
SELECT o_orderkey, o_totalprice FROM orders
WHERE (o_totalprice BETWEEN 1000 AND 150000.5 AND o_orderstatus NOT IN ('F', 'P'))
   OR substr(o_orderpriority, 1, 1) >= '5'""",
    ),
    "log_dedupe": Query(
        lambda spark, folder: log.drop_consecutive(
            entries(spark, folder), "id", ["where_text"], within=["dataset_path"]
        ),
        _deduped("PARTITION BY dataset_path"),
    ),
    "log_dedupe_global": Query(
        lambda spark, folder: log.drop_consecutive(
            entries(spark, folder), "id", ["dataset_path", "where_text"]
        ),
        _deduped(""),
    ),
    "log_append": Query(
        lambda spark, folder: log.drop_consecutive(
            log.cleaned(untidy(spark, folder)),
            "id",
            ["dataset_path", "where_text"],
            latest=(0, "click"),
            ids_per_group=1_000,
        ),
        """
WITH tidy AS (
  SELECT event_id AS id, user_id % 2 AS dataset_path,
         CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS where_text
  FROM events WHERE event_type <> 'error'
)
SELECT id, dataset_path, where_text FROM (
  SELECT *, lag(where_text, 1, 'click') OVER (ORDER BY id) AS text_before,
         lag(dataset_path, 1, 0) OVER (ORDER BY id) AS path_before
  FROM tidy
) AS l
WHERE text_before <> where_text OR path_before <> dataset_path""",
    ),
    "log_keep_latest": Query(
        lambda spark, folder: log.keep_latest(entries(spark, folder)),
        f"SELECT {_ENTRY} FROM events ORDER BY event_id DESC LIMIT 500",
    ),
    "log_list": Query(
        lambda spark, folder: log.listed(entries(spark, folder)),
        f"SELECT {_ENTRY} FROM events",
    ),
    "log_list_one": Query(
        lambda spark, folder: log.listed(entries(spark, folder), path=8),
        f"SELECT {_ENTRY} FROM events WHERE user_id = 8",
    ),
    "log_delete": Query(
        lambda spark, folder: log.without_entries(
            entries(spark, folder),
            entries(spark, folder).filter(F.col("where_text") == "error").select("id"),
        ),
        f"SELECT {_ENTRY} FROM events WHERE event_type <> 'error'",
    ),
    "log_clear_one": Query(
        lambda spark, folder: log.without_path(entries(spark, folder), 8),
        f"SELECT {_ENTRY} FROM events WHERE user_id <> 8",
    ),
}
