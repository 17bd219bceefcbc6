"""Queries on columns, order, pages, counts and search of a view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableview.catalog import SOURCE_ROW
from tableview.functions.conditions import var
from tableview.operators.search import RESULT, find, find_frame
from tableview.operators.view import PAGE_ROWS, View, page_start
from tableview.plans.conditions import EVENT_GAPS_SQL, event_gaps
from tableview.plans.registry import Query, view

EXPENSIVE = (var("o_orderstatus") == "F") & (var("o_totalprice") >= 100000)

# The view of most queries here: finished expensive orders, the dearest first.
EXPENSIVE_SQL = """
(SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS _view_row,
        o_orderkey, o_totalprice, o_orderpriority
 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000) AS v"""

_SHOWN = "_view_row, o_orderkey, o_totalprice, o_orderpriority"


def expensive(spark, folder) -> View:
    return (
        view(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice", "o_orderpriority")
        .where(EXPENSIVE)
        .sort_by("o_totalprice", ascending=False)
    )


def flagship(spark, folder):
    """Count-free first page: filter, project, stable sort, top 500."""
    return (
        view(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .where(EXPENSIVE)
        .sort_by("o_totalprice", ascending=False)
        .page(0, PAGE_ROWS)
    )


def with_gaps(spark, folder) -> View:
    events = view(spark, folder, "events", derive=event_gaps())
    return events.select("event_id", "event_type", "value")


def _numbered(order: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY {order}) - 1 AS _view_row, event_id + 1 AS _source_row,
       event_id, event_type, value
FROM {EVENT_GAPS_SQL}"""


def _found(
    start: int | None, forward: bool = True, text: str = "1-urg"
) -> Query:
    """Find next or previous in the expensive orders, against a two-step search in SQL."""

    def run(spark, folder):
        return find_frame(expensive(spark, folder), text, start, forward=forward)

    begin = start if start is not None else (-1 if forward else 2**62)
    first, beyond = ("min", ">") if forward else ("max", "<")
    return Query(
        run,
        f"""
WITH hits AS (
  SELECT _view_row,
         CASE WHEN contains(lower(CAST(o_orderkey AS VARCHAR)), lower('{text}'))
                THEN 'o_orderkey'
              WHEN contains(lower(CAST(o_totalprice AS VARCHAR)), lower('{text}'))
                THEN 'o_totalprice'
              ELSE 'o_orderpriority' END AS column_name
  FROM {EXPENSIVE_SQL}
  WHERE contains(lower(CAST(o_orderkey AS VARCHAR)), lower('{text}'))
     OR contains(lower(CAST(o_totalprice AS VARCHAR)), lower('{text}'))
     OR contains(lower(o_orderpriority), lower('{text}'))
)
SELECT _view_row AS row_index, column_name FROM hits
WHERE _view_row = coalesce((SELECT {first}(_view_row) FROM hits WHERE _view_row {beyond} {begin}),
                           (SELECT {first}(_view_row) FROM hits))""",
    )


def _found_by_index(text: str, start: int) -> Query:
    """The same search through a skip index, one call of `find`."""

    def run(spark, folder):
        shown = expensive(spark, folder).index_text()
        hit = find(shown, text, start)
        return spark.createDataFrame([] if hit is None else [(hit.row_index, hit.column_name)], RESULT)

    return Query(run, _found(start, text=text).sql)


def _expensive_rows(low: int, high: int) -> str:
    return f"SELECT {_SHOWN} FROM {EXPENSIVE_SQL} WHERE _view_row >= {low} AND _view_row < {high}"


DEEP_ROW = 2_718

QUERIES = {
    "flagship_page": Query(
        flagship,
        f"SELECT _view_row, o_orderkey, o_totalprice FROM {EXPENSIVE_SQL} WHERE _view_row < 500",
    ),
    "select_visible": Query(
        lambda spark, folder: view(spark, folder, "customer")
        .select("c_name", "c_acctbal")
        .rows()
        .drop(SOURCE_ROW),
        "SELECT c_name, c_acctbal FROM customer",
    ),
    "select_reordered": Query(
        lambda spark, folder: view(spark, folder, "customer")
        .hide("c_custkey", "c_acctbal")
        .show("c_custkey")
        .rows()
        .drop(SOURCE_ROW),
        "SELECT c_name, c_nationkey, c_mktsegment, c_custkey FROM customer",
    ),
    "display_text": Query(
        lambda spark, folder: view(spark, folder, "customer").text_cells().drop(SOURCE_ROW),
        """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
       c_mktsegment
FROM customer""",
    ),
    "display_text_missing": Query(
        lambda spark, folder: with_gaps(spark, folder).text_cells("Missing"),
        f"""
SELECT event_id + 1 AS _source_row, CAST(event_id AS VARCHAR) AS event_id,
       coalesce(event_type, 'Missing') AS event_type,
       coalesce(CAST(value AS VARCHAR), 'Missing') AS value
FROM {EVENT_GAPS_SQL}""",
    ),
    "order_source": Query(
        lambda spark, folder: view(spark, folder, "orders").view_rows(),
        """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _view_row,
       row_number() OVER (ORDER BY o_orderkey) AS _source_row, *
FROM orders""",
    ),
    "sort_asc": Query(
        lambda spark, folder: with_gaps(spark, folder).sort_by("event_type").view_rows(),
        _numbered("event_type ASC NULLS FIRST, event_id"),
    ),
    "sort_desc": Query(
        lambda spark, folder: with_gaps(spark, folder)
        .sort_by("event_type", ascending=False)
        .view_rows(),
        _numbered("event_type DESC NULLS LAST, event_id"),
    ),
    "sort_number_asc": Query(
        lambda spark, folder: with_gaps(spark, folder).sort_by("value").view_rows(),
        _numbered("value ASC NULLS FIRST, event_id"),
    ),
    "sort_number_desc": Query(
        lambda spark, folder: with_gaps(spark, folder)
        .sort_by("value", ascending=False)
        .view_rows(),
        _numbered("value DESC NULLS LAST, event_id"),
    ),
    "view_index": Query(
        lambda spark, folder: expensive(spark, folder).view_rows().drop(SOURCE_ROW),
        f"SELECT {_SHOWN} FROM {EXPENSIVE_SQL}",
    ),
    "page_first": Query(
        lambda spark, folder: expensive(spark, folder).page(), _expensive_rows(0, 500)
    ),
    "page_middle": Query(
        lambda spark, folder: expensive(spark, folder).page(1_000, 500),
        _expensive_rows(1_000, 1_500),
    ),
    "page_source_order": Query(
        lambda spark, folder: view(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .page(7_000, 500),
        """
SELECT o_orderkey AS _view_row, o_orderkey, o_custkey FROM orders
WHERE o_orderkey >= 7000 AND o_orderkey < 7500""",
    ),
    "page_deep": Query(
        lambda spark, folder: expensive(spark, folder).slice(
            page_start(DEEP_ROW), page_start(DEEP_ROW) + PAGE_ROWS
        ),
        _expensive_rows(2_500, 3_000),
    ),
    "goto_row": Query(
        lambda spark, folder: expensive(spark, folder).row(DEEP_ROW),
        _expensive_rows(DEEP_ROW - 1, DEEP_ROW),
    ),
    "goto_row_out_of_range": Query(
        lambda spark, folder: expensive(spark, folder).row(10**12),
        _expensive_rows(10**12 - 1, 10**12),
    ),
    "slice_rows": Query(
        lambda spark, folder: expensive(spark, folder).slice(
            1_234, 2_345, ("o_orderpriority", "o_orderkey")
        ),
        f"""
SELECT _view_row, o_orderpriority, o_orderkey FROM {EXPENSIVE_SQL}
WHERE _view_row >= 1234 AND _view_row < 2345""",
    ),
    "copied_block": Query(
        lambda spark, folder: expensive(spark, folder).copied_block(
            600, 1_300, ("o_orderkey", "o_orderpriority"), headers=True
        ),
        f"""
SELECT -1 AS _view_row, concat('o_orderkey', chr(9), 'o_orderpriority') AS line
UNION ALL
SELECT _view_row, concat(CAST(o_orderkey AS VARCHAR), chr(9), o_orderpriority) AS line
FROM {EXPENSIVE_SQL} WHERE _view_row >= 600 AND _view_row < 1300""",
    ),
    "index_filtered": Query(
        lambda spark, folder: view(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .where(EXPENSIVE)
        .view_rows(),
        """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _view_row, o_orderkey + 1 AS _source_row,
       o_orderkey, o_custkey
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000""",
    ),
    "filtered_count": Query(
        lambda spark, folder: expensive(spark, folder)
        .summary()
        .select(F.col("filtered_rows").alias("rows")),
        f"SELECT count(*) AS rows FROM {EXPENSIVE_SQL}",
    ),
    "view_summary": Query(
        lambda spark, folder: expensive(spark, folder).summary(),
        """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice >= 100000) AS filtered_rows,
       count(*) AS total_rows, 3 AS visible_columns, true AS filtered
FROM orders""",
    ),
    "find_next": _found(100),
    "find_first": _found(None),
    "find_prev": _found(100, forward=False),
    "find_last": _found(None, forward=False),
    "find_wrap": _found(10**9),
    "find_wrap_back": _found(0, forward=False),
    "find_column": _found(500, text="99"),
    "find_indexed": _found_by_index("3-med", 700),
    "match_indexed": Query(
        lambda spark, folder: view(spark, folder, "documents")
        .select("doc_id", "lang", "source")
        .index_text()
        .matching("SRC1")
        .drop(SOURCE_ROW),
        "SELECT doc_id, lang, source FROM documents WHERE contains(lower(source), 'src1')",
    ),
    "find_none": Query(
        lambda spark, folder: find_frame(expensive(spark, folder), "no such text"),
        """
SELECT CAST(NULL AS BIGINT) AS row_index, CAST(NULL AS VARCHAR) AS column_name
FROM orders WHERE false""",
    ),
}
