"""Columns of documents keep their names and values in every stage, whatever they are called."""

from __future__ import annotations

import pytest

from tableview.catalog import quoted
from tableview.llm import decontaminate, jaccard_join, language, line_dedup, pii

SCHEMA = "doc_id long, text string, lang string, `a.b` string, __text string, n_words long, `t``k` int"
ROWS = [(at, f"the number {at} of these words stands {'here ' * at}", "en", "dot", "own", 7, at) for at in range(6)]

STAGES = {
    "language": lambda docs, items: language.accepted(docs, most_bits=99.0),
    "lines": lambda docs, items: line_dedup.deduplicated(docs),
    "documents": lambda docs, items: jaccard_join.deduplicated(docs),
    "benchmark": lambda docs, items: decontaminate.clean(docs, items),
    "benchmark joined": lambda docs, items: decontaminate.clean(docs, items, salts=3),
    "personal data": lambda docs, items: pii.sanitised(docs),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_stage(spark, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    items = spark.createDataFrame([(1, "nothing of that"), (2, "nor any of this")], "item_id long, text string")
    kept = STAGES[stage](docs, items)
    assert kept.columns == docs.columns
    own = {(row[0], *row[2:]) for row in ROWS}
    rows = kept.select(*map(quoted, kept.columns)).collect()
    assert rows and {(row[0], *row[2:]) for row in rows} <= own
