"""One query per kind of condition, on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableview.catalog import SOURCE_ROW
from tableview.functions.conditions import Condition, everything, missing, var
from tableview.plans.registry import Query, view

# The given tables have no missing values; these columns get some.
def event_gaps() -> dict[str, Column]:
    kind, value = F.col("event_type"), F.col("value")
    return {
        "event_type": F.when(kind == "view", F.lit(""))
        .when(kind == "error", F.lit(None))
        .otherwise(kind),
        "value": F.when(value >= 50, value),
    }


def document_gaps() -> dict[str, Column]:
    lang = F.col("lang")
    return {"lang": F.when(lang == "fr", F.lit("")).when(lang != "de", lang)}


EVENT_GAPS_SQL = """
(SELECT event_id, user_id,
        CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'error' THEN NULL
             ELSE event_type END AS event_type,
        CASE WHEN value >= 50 THEN value END AS value
 FROM events) AS e"""

DOCUMENT_GAPS_SQL = """
(SELECT doc_id, text, source, n_chars,
        CASE WHEN lang = 'fr' THEN '' WHEN lang <> 'de' THEN lang END AS lang
 FROM documents) AS d"""


GAPS = {"": dict, EVENT_GAPS_SQL: event_gaps, DOCUMENT_GAPS_SQL: document_gaps}


def _where(table: str, columns: list[str], condition: Condition, sql: str, source: str = ""):
    def run(spark, folder):
        shown = view(spark, folder, table, derive=GAPS[source]()).select(*columns)
        return shown.where(condition).rows().drop(SOURCE_ROW)

    listed = ", ".join(columns)
    return Query(run, f"SELECT {listed} FROM {source or table} WHERE {sql}")


_ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
_PART = ["p_partkey", "p_name", "p_type", "p_brand"]
_EVENT = ["event_id", "event_type", "value"]
_DOC = ["doc_id", "lang", "source"]


def _event(condition: Condition, sql: str) -> Query:
    return _where("events", _EVENT, condition, sql, EVENT_GAPS_SQL)


def _doc(condition: Condition, sql: str) -> Query:
    return _where("documents", _DOC, condition, sql, DOCUMENT_GAPS_SQL)


_PREFIX_SQL = "substr(coalesce(event_type, ''), 1, 2)"
_SHARED_SQL = "least(length(coalesce(lang, '')), length(coalesce(source, '')))"

QUERIES = {
    "where_eq": _where("orders", _ORDER, var("o_orderstatus") == "F", "o_orderstatus = 'F'"),
    "where_ne": _event(var("event_type") != "click", "event_type <> 'click'"),
    "where_gt": _where("orders", _ORDER, var("o_totalprice") > 250000, "o_totalprice > 250000"),
    "where_ge": _where("lineitem", _LINE, var("l_quantity") >= 30, "l_quantity >= 30"),
    "where_lt": _event(var("event_type") < "click", "event_type < 'click'"),
    "where_le": _event(var("value") <= 75.5, "value <= 75.5"),
    "where_temporal": _where(
        "orders",
        ["o_orderkey", "o_orderdate"],
        var("o_orderdate") >= dt.datetime(1998, 6, 1),
        "o_orderdate >= TIMESTAMP '1998-06-01'",
    ),
    "where_col_col": _where(
        "lineitem", _LINE, var("l_discount") < var("l_tax"), "l_discount < l_tax"
    ),
    "where_prefix": _where(
        "part", _PART, var("p_type").starts_with("ST"), "substr(coalesce(p_type, ''), 1, 2) = 'ST'"
    ),
    "where_prefix_not": _event(
        ~var("event_type").starts_with("cl"), f"NOT ({_PREFIX_SQL} = 'cl')"
    ),
    "where_prefix_ne": _event(var("event_type").prefix("!=", "cl"), f"{_PREFIX_SQL} <> 'cl'"),
    "where_prefix_lt": _event(var("event_type").prefix("<", "pu"), f"{_PREFIX_SQL} < 'pu'"),
    "where_prefix_le": _event(var("event_type").prefix("<=", "pu"), f"{_PREFIX_SQL} <= 'pu'"),
    "where_prefix_gt": _event(var("event_type").prefix(">", "cl"), f"{_PREFIX_SQL} > 'cl'"),
    "where_prefix_ge": _event(var("event_type").prefix(">=", "cl"), f"{_PREFIX_SQL} >= 'cl'"),
    "where_prefix_col": _doc(
        var("source").prefix(">=", var("lang")),
        f"substr(source, 1, {_SHARED_SQL}) >= substr(coalesce(lang, ''), 1, {_SHARED_SQL})",
    ),
    "where_prefix_col_eq": _doc(
        var("lang").starts_with(var("source")),
        f"substr(coalesce(lang, ''), 1, {_SHARED_SQL}) = substr(source, 1, {_SHARED_SQL})",
    ),
    "where_in": _where(
        "lineitem", _LINE, var("l_linenumber").is_in(1, 3, 7), "l_linenumber IN (1, 3, 7)"
    ),
    "where_not_in": _event(
        var("event_type").not_in("click", ""), "event_type NOT IN ('click', '')"
    ),
    "where_between": _where(
        "orders", _ORDER, var("o_totalprice").between(1e5, 2e5), "o_totalprice BETWEEN 1e5 AND 2e5"
    ),
    "where_between_cols": _where(
        "lineitem",
        _LINE,
        var("l_quantity").between(var("l_linenumber"), 30),
        "l_quantity BETWEEN l_linenumber AND 30",
    ),
    "where_between_reversed": _where(
        "orders", _ORDER, var("o_totalprice").between(2e5, 1e5), "o_totalprice BETWEEN 2e5 AND 1e5"
    ),
    "where_not_between": _event(var("value").not_between(60, 90), "value NOT BETWEEN 60 AND 90"),
    "where_contains": _where(
        "documents",
        ["doc_id", "text"],
        var("text").contains("license"),
        "contains(text, 'license')",
    ),
    "where_contains_col": _where(
        "documents",
        ["doc_id", "lang", "source"],
        var("text").contains(var("lang")),
        "contains(coalesce(text, ''), coalesce(lang, ''))",
        DOCUMENT_GAPS_SQL,
    ),
    "where_not_contains": _event(
        var("event_type").not_contains("li"), "NOT contains(coalesce(event_type, ''), 'li')"
    ),
    "where_like": _where("part", _PART, var("p_name").like("s%_d%"), "p_name LIKE 's%_d%'"),
    "where_like_escape": _where(
        "pages", ["page_id", "url"], var("url").like("%#?page#_%#%%", "?"),
        "url LIKE '%#?page#_%#%%' ESCAPE '?'",
    ),
    "where_like_escaped_wildcard": _where(
        "documents",
        ["doc_id", "lang"],
        var("text").like("%100#%%", "#") | var("text").like("%#_%", "#"),
        "text LIKE '%100#%%' ESCAPE '#' OR text LIKE '%#_%' ESCAPE '#'",
    ),
    "where_not_like": _event(var("event_type").not_like("c%"), "event_type NOT LIKE 'c%'"),
    "where_missing_char": _event(
        var("event_type").is_missing(), "event_type IS NULL OR event_type = ''"
    ),
    "where_missing_num": _event(missing("value"), "value IS NULL"),
    "where_not_missing": _event(
        var("event_type").is_not_missing() & ~missing("value"),
        "NOT (event_type IS NULL OR event_type = '') AND value IS NOT NULL",
    ),
    "where_and": _where(
        "orders",
        _ORDER,
        (var("o_orderstatus") == "F") & (var("o_totalprice") >= 100000),
        "o_orderstatus = 'F' AND o_totalprice >= 100000",
    ),
    "where_or": _event(
        (var("event_type") == "click") | (var("value") > 90), "event_type = 'click' OR value > 90"
    ),
    "where_not": _event(
        ~((var("event_type") == "click") | (var("value") > 90)),
        "NOT (event_type = 'click' OR value > 90)",
    ),
    "where_nested": _event(
        (var("event_type").contains("li") | var("user_id").is_in(18, 65))
        & ~(missing("value") | ~(var("value") < 80)),
        "(contains(coalesce(event_type, ''), 'li') OR user_id IN (18, 65))"
        " AND NOT (value IS NULL OR NOT (value < 80))",
    ),
    "where_empty": Query(
        lambda spark, folder: view(spark, folder, "orders")
        .select(*_ORDER)
        .where(everything())
        .rows()
        .drop(SOURCE_ROW),
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    ),
    "match_any_column": Query(
        lambda spark, folder: view(spark, folder, "orders")
        .select("o_orderkey", "o_orderstatus", "o_orderpriority")
        .matching("99")
        .drop(SOURCE_ROW)
        .unionAll(
            view(spark, folder, "orders")
            .select("o_orderkey", "o_orderstatus", "o_orderpriority")
            .matching("uRGeNt")
            .drop(SOURCE_ROW)
        ),
        """
SELECT o_orderkey, o_orderstatus, o_orderpriority
FROM orders CROSS JOIN (VALUES ('99'), ('uRGeNt')) AS n(needle)
WHERE contains(lower(coalesce(CAST(o_orderkey AS VARCHAR), '')), lower(needle))
   OR contains(lower(coalesce(o_orderstatus, '')), lower(needle))
   OR contains(lower(coalesce(o_orderpriority, '')), lower(needle))""",
    ),
    "match_any_text": Query(
        lambda spark, folder: view(spark, folder, "documents", derive=document_gaps())
        .select("doc_id", "text", "lang")
        .matching("LÉ")
        .drop(SOURCE_ROW),
        f"""
SELECT doc_id, text, lang FROM {DOCUMENT_GAPS_SQL}
WHERE contains(lower(CAST(doc_id AS VARCHAR)), 'lé') OR contains(lower(text), 'lé')
   OR contains(lower(coalesce(lang, '')), 'lé')""",
    ),
}
