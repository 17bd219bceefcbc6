from __future__ import annotations

from pyspark.sql import functions as F

from tableview.llm import jaccard_join


def least(n, m):
    """What sets of n and m shingles at 75 percent share of their prefixes, at least."""
    overlap = -(-75 * (n + m) // 175)
    return max(1, overlap - max(-(-75 * n // 100), -(-75 * m // 100)) + 1)


def test_groups_are_opened_for_every_size_between_their_ends(spark):
    rows = []
    for n in [*range(1, 60), 100]:
        sizes = range(-(-75 * n // 100), 100 * n // 75 + 1)
        rows += [(n, low, high) for low in sizes for high in sizes if low <= high]
    asked = jaccard_join._least_opening(75, F.col("n"), F.col("low"), F.col("high"))
    frame = spark.createDataFrame(rows, "n long, low long, high long")
    for n, low, high, bound in frame.select("n", "low", "high", asked.alias("bound")).collect():
        assert 1 <= bound <= min(least(n, m) for m in range(low, high + 1)), (n, low, high)
