from __future__ import annotations

import math

import numpy as np

from tableview.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, rank int"


def brute(rows, k=20, every=20):
    good = [
        (i, np.array(v, np.float64))
        for i, v in rows
        if i is not None
        and v
        and all(e is not None and math.isfinite(e) for e in v)
        and any(e != 0 for e in v)
    ]
    found = {}
    for i, v in good:
        if i % every == 0:
            near = [(-float((w * v).sum()), j) for j, w in good if j != i and len(w) == len(v)]
            found[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return found


def recall(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    found = {}
    for row in neighbours.nearest(frame, **options).collect():
        found.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    wanted = brute(rows)
    assert set(found) == {i for i, near in wanted.items() if near}
    hit = total = 0
    for query, near in found.items():
        near.sort()
        assert [rank for rank, _, _ in near] == list(range(1, len(wanted[query]) + 1))
        assert [(s, -j) for _, j, s in near] == sorted(((s, -j) for _, j, s in near), reverse=True)
        assert query not in [j for _, j, _ in near]
        hit += len({j for _, j, _ in near} & {j for j, _ in wanted[query]})
        total += len(near)
    return hit / total


def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(row.vec_id, list(row.embedding)) for row in table.collect()]
    assert recall(spark, rows, shard=500) >= 0.95


def test_lengths_differ_and_copies_are_many(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32) * rng.uniform(0.1, 4, (700, 1))
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)]
    assert recall(spark, rows) >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None])]
    rows += [(6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(20, [1.0, 1.0, 1.0]), (40, [-1.0, 0.0]), (21, [1.0, 0.0]), (60, [3.0, 3.0, 3.0, 3.0])]
    assert recall(spark, rows) == 1.0


def test_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0
