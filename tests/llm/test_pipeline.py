from __future__ import annotations

import corpus_pipeline
import test_decontaminate
import test_jaccard_join
import test_line_dedup
import test_packing
from tableview.llm import packing
from tableview.llm.tables import read

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_agree_with_brute_force(spark):
    docs = read(spark, FOLDER, "documents")
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    items = [(row.item_id, row.text) for row in read(spark, FOLDER, "benchmark").collect()]
    wanted = [row for row in rows if any(char.isalpha() for char in row[1] or "")]
    gone = test_line_dedup.removed(wanted)
    left = []
    for doc, text in wanted:
        own = gone.get((doc, text))
        text = test_line_dedup.left(text, own) if own else text
        kept = any(test_line_dedup.normalised(line) for line in text.split("\n"))
        if not own or kept:
            left.append((doc, text))
    first = {row[2] for row in test_jaccard_join.brute(left)}
    left = [row for row in left if row[0] in first]
    fine = {row[0] for row in test_decontaminate.brute(left, items) if not row[5]}
    left = [row for row in left if row[0] in fine]

    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, FOLDER)
        assert held.columns == docs.columns, name
    assert sorted((row.doc_id, row.text) for row in held.collect()) == sorted(left)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    test_packing.check(left, packed, packing.CAPACITY, packing.PER_SOURCE)


def test_stages_on_an_empty_table(spark):
    docs = read(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER) if docs.columns[0] == "doc_id" else docs
        assert docs.count() == 0
