from __future__ import annotations

import random

from tableview.llm import jaccard_join

DOCS = "doc_id long, text string, key string"


def shingles(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = [(doc, shingles(text)) for doc, text, *_ in docs]
    root = {doc: doc for doc, _ in sets if doc is not None}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for at, (a, one) in enumerate(sets):
        for b, other in sets[:at]:
            if a is None or b is None or not one or not other:
                continue
            common = len(one & other)
            if 100 * common >= 75 * (len(one) + len(other) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [(doc, len(own), None if doc is None else find(doc)) for doc, own in sets]
    return sorted(rows, key=str)


def cases():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "  \t\n", "one", "One", "one two three four", "five word text is here"]
    line = " ".join(rng.choices(vocabulary, k=14))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 90))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + "\n" + line * rng.randint(0, 1))
    family = rng.choices(vocabulary, k=60)
    for _ in range(60):
        copy = list(family)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += ["word " * 30_000, "WORD " * 30_000, texts[20], texts[20], texts[20].upper()]
    rows = [(i, text, "x") for i, text in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[20], None), (None, None, None), (33, texts[33], "y")]


def found_in(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = cases()
    frame = spark.createDataFrame(docs, DOCS)
    wanted = brute(docs)
    assert found_in(jaccard_join.grouped(frame)) == wanted
    # Few shingles count as rare, blocks of comparisons are small, ids are joined by a shuffle.
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    monkeypatch.setattr(jaccard_join, "MOST_SENT", 0)
    assert found_in(jaccard_join.grouped(frame, hot=3)) == wanted
    assert found_in(jaccard_join.grouped(frame, hot=2, most_hot=40)) == wanted


def test_one_document_of_each_group_stays(spark):
    docs = cases()
    frame = spark.createDataFrame(docs, DOCS)
    kept = jaccard_join.deduplicated(frame)
    assert kept.columns == frame.columns
    wanted = {row[2] for row in brute(docs) if row[2] is not None}
    ids = [row.doc_id for row in kept.collect()]
    assert {i for i in ids if i is not None} == wanted
    assert len([i for i in ids if i is not None]) == len(wanted) and ids.count(None) == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard_join.grouped(none).count() == jaccard_join.deduplicated(none).count() == 0
