from __future__ import annotations

import hashlib
import random
from collections import Counter

from tableview.llm import suffixes

DOCS = "doc_id long, text string, removed string"


def brute(docs, length):
    texts = [(doc, (text or "").encode()) for doc, text, *_ in docs]
    counts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    rows = []
    for doc, text in texts:
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(byte for byte, g in zip(text, gone) if not g)
        rows.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def found_in(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def test_suffix_arrays_are_sorted():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        text = bytes(rng.choices([1, 2, 250], k=rng.randint(1, 200))) + b"\0"
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8), len(text)).tolist()
        assert order == sorted(range(len(text)), key=lambda at: text[at:])
        shared = suffixes.common_prefixes(np.frombuffer(text, np.uint8), np.array(order), 9)
        for a, b, n in zip(order, order[1:], shared.tolist()):
            same = next((i for i in range(9) if text[a + i : a + i + 1] != text[b + i : b + i + 1]), 9)
            assert n == same or n > same >= len(text) - max(a, b)


def cases():
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdé", k=90))
    texts = [None, "", "short", "é" * 300, "ab" * 200]
    for _ in range(40):
        own = "".join(rng.choices("abcdé ", k=rng.randint(0, 120)))
        cut = rng.randint(0, 60)
        texts.append(own + passage[cut : cut + rng.randint(0, 60)] + own[::-1])
    texts += [texts[9], texts[9] + "!", texts[12][5:]]
    rows = [(i, text, "x") for i, text in enumerate(texts)]
    return rows + [(None, texts[10], None), (9, texts[9], None)]


def test_against_brute_force(spark, monkeypatch):
    docs = cases()
    frame = spark.createDataFrame(docs, DOCS)
    wanted = brute(docs, 24)
    assert sum(row[2] > 0 for row in wanted) > 20
    assert found_in(suffixes.summary(frame, length=24, gram=8)) == wanted
    # Anchors with more than two kinds of segments count as crowded.
    assert found_in(suffixes.summary(frame, length=24, gram=8, crowd=2)) == wanted
    # Places and repeated strings travel by a shuffle.
    monkeypatch.setattr(suffixes, "MOST_SENT", 0)
    monkeypatch.setattr(suffixes, "BUCKET", 500)
    assert found_in(suffixes.summary(frame, length=24, gram=8, crowd=2)) == wanted


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found_in(suffixes.summary(docs)) == brute(docs.collect(), 200)


def test_empty_table(spark):
    assert suffixes.summary(spark.createDataFrame([], DOCS)).count() == 0
