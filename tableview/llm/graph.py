"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableview.llm.tables import discard, written


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every id in the pairs (a, b); the component is its smallest id.

    Each round every node points to the neighbour of smallest hash, pointers are followed once
    more, and the edges between what is left go on. The hash changes with the round, so that no
    numbering of the nodes makes the rounds many. All steps are joins and groupings that combine
    on the map side; nothing is gathered anywhere.
    """
    edges = written(_between(pairs, "a", "b"), "edges")
    steps = []
    for turn in count():
        if edges.isEmpty():
            break

        def rank(column, turn=turn):
            return F.struct(F.xxhash64(column, F.lit(turn)).alias("r"), F.col(column).alias("id"))

        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        up = nearest.select(
            F.col("a").alias("id"),
            F.least("best", rank("a"))["id"].alias("up"),
        )
        up = written(up, "up")
        above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        step = written(up.join(above, "up").select("id", F.col("top").alias("up")), "step")
        steps.append(step)
        left = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
        left = written(_between(left, "x", "y"), "edges")
        discard(up, edges)
        edges = left
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    tops = steps[0]
    for step in steps[1:]:
        further = step.toDF("up", "top")
        tops = tops.join(further, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
    tops = written(tops, "tops")
    discard(edges, *steps)
    least = tops.groupBy("up").agg(F.min("id").alias("component"))
    return tops.join(least, "up").select("id", "component")


def _between(frame: DataFrame, one: str, other: str) -> DataFrame:
    return (
        frame.where(F.col(one) != F.col(other))
        .select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
        .distinct()
    )
