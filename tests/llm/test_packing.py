from __future__ import annotations

import random
from collections import Counter, defaultdict

from tableview.llm import packing

DOCS = "doc_id long, text string, source string, place int"


def naive(sizes, sources, clusters, capacity, per_source):
    bins, chosen = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (left, at)
            for at, (left, held, own) in enumerate(bins)
            if left >= size and cluster not in own and held[source] < per_source
        ]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append([capacity, Counter(), set()])
        bins[at][0] -= size
        bins[at][1][source] += 1
        bins[at][2].add(cluster)
        chosen.append(at)
    return chosen


def test_best_fit_against_a_naive_search():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(0, 120)
        sizes = [rng.randint(0, 50) for _ in range(n)]
        sources = [rng.choice(["a", "b", None]) for _ in range(n)]
        clusters = [rng.randint(0, 30) for _ in range(n)]
        for per_source in (1, 3):
            args = (sizes, sources, clusters, 60, per_source)
            assert packing.best_fit(*args) == naive(*args)


def check(docs, rows, capacity, per_source):
    words = Counter()
    for doc, text, *_ in docs:
        words[doc] += len((text or "").encode().split())
    bins = defaultdict(list)
    covered = Counter()
    for row in rows:
        bins[row.bin_id].append(row)
        covered[row.doc_id] += row.n_words
        assert row.first_word == row.piece * capacity
    assert covered == words
    for held in bins.values():
        assert sum(row.n_words for row in held) <= capacity
        assert sorted(row.place for row in held) == list(range(len(held)))
        assert max(Counter(row.source for row in held).values()) <= per_source
        assert max(Counter(row.cluster for row in held).values()) == 1
    return bins


def test_packed(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randint(0, 70), rng.choice(["s", "s", "t"]), 1) for i in range(150)]
    docs += [(200, None, None, 1), (201, "", "s", 1), (202, "long " * 1_000, "s", 1)]
    docs += [(None, "x y", "t", 1), (7, "Same  TEXT", "s", 1), (7, "same text", "s", 1)] * 2
    frame = spark.createDataFrame(docs, DOCS)
    rows = packing.packed(frame, capacity=64, per_source=2, shard_items=40).collect()
    check(docs, rows, 64, 2)
    one = packing.packed(frame, capacity=64, per_source=2, shard_items=10_000).collect()
    bins = check(docs, one, 64, 2)
    same = {row.cluster for row in one if row.doc_id == 7 and row.n_words == 2}
    assert len(same) == 1 and len(bins) >= 4


def test_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(row.doc_id, row.text) for row in frame.collect()]
    check(docs, packing.packed(frame).collect(), packing.CAPACITY, packing.PER_SOURCE)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0
