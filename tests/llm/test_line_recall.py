from __future__ import annotations

import random

from tableview.llm import line_dedup

DOCS = "doc_id long, text string"
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]


def _changed(rng, line, vocabulary, how):
    words = line.split(" ")
    at = rng.randrange(len(words))
    if how == "word":
        words[at] = rng.choice(vocabulary)
    else:
        words[at] = words[at][:1] + "x" + words[at][2:]
    return " ".join(words)


def test_one_changed_word_or_letter_is_found(spark):
    """Recall against edit similarity alone, on lines of 10 to 50 words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(SYLLABLES, k=rng.choice([1, 2, 3, 4]))) for _ in range(3000)]
    for how, words in [(how, n) for how in ("word", "letter") for n in (10, 20, 50)]:
        docs = []
        for at in range(100):
            line = " ".join(rng.choices(vocabulary, k=words))
            docs += [(2 * at, line), (2 * at + 1, _changed(rng, line, vocabulary, how))]
        rows = line_dedup.summary(spark.createDataFrame(docs, DOCS)).collect()
        found = sum(len(row.removed) for row in rows if row.doc_id % 2)
        assert all(not row.removed for row in rows if row.doc_id % 2 == 0)
        assert found >= 95, (how, words, found)


def test_lines_that_differ_in_digits_are_one_kind(spark):
    docs = [(i, f"Posted on 2024-01-{i:02} at {i}{i}:15 by the editors") for i in range(10, 30)]
    rows = line_dedup.summary(spark.createDataFrame(docs, DOCS)).collect()
    assert [row.doc_id for row in rows if not row.removed] == [10]


def test_documents_with_short_lines_left_stay(spark):
    licence = "Licensed under the terms of the common licence"
    verse = "\n".join(f"line {chr(97 + i)}" for i in range(20))
    docs = [(0, licence), (1, f"{licence}\n{verse}"), (2, f"{licence}\n \n"), (3, f"{licence}\n  x")]
    kept = line_dedup.deduplicated(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(map(tuple, kept)) == [(0, licence), (1, verse), (3, "  x")]
