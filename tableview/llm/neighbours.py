"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Vectors get one more coordinate, the root of what their squared length lacks to the longest one's;
queries get a 0 there. The largest inner product is then the smallest Euclidean distance.

Equal vectors are one node, with the smallest of their ids: more than `K` + 1 of them can never be
asked for. Nodes are dealt by hash to shards of about `SHARD` nodes. In a shard a graph is built
from a random one: a greedy search proposes neighbours of each node; of the proposals, nearest first,
each one kept removes those it is nearer to by the factor `ALPHA` than the node is; edges are added
backwards too and pruned in the same way. Every query searches every shard with a beam of `BEAM`
nodes, in blocks of queries, and the shards' results are merged by exact inner products in double
precision of the original vectors. Measured against brute force, the share of true neighbours found
is above 0.9 (the tests require it).

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id. Vectors only meet vectors of their own length. A vec_id given more than once stands
for each of its vectors; as a query each of them is searched, and finds no row of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableview.llm.tables import written

K = 20
EVERY = 20
SHARD = 8_192
DEGREE = 32
BEAM = 96
ALPHA = 1.2
BLOCK = 256
QUERIES = 2_048


def pruned(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float):
    """At most `degree` diverse neighbours of each node among its proposals (-1: none)."""
    proposed = np.sort(proposed, axis=1)
    dead = (proposed < 0) | (proposed == nodes[:, None])
    dead[:, 1:] |= proposed[:, 1:] == proposed[:, :-1]
    points = x[np.maximum(proposed, 0)]
    away = ((points - x[nodes][:, None]) ** 2).sum(axis=2)
    away[dead] = np.inf
    length = (points**2).sum(axis=2)
    between = length[:, :, None] + length[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    kept = np.full((len(nodes), degree), -1, np.int32)
    alive, rows = away.copy(), np.arange(len(nodes))
    for place in range(degree):
        best = alive.argmin(axis=1)
        found = np.isfinite(alive[rows, best])
        if not found.any():
            break
        kept[found, place] = proposed[rows, best][found]
        alive[alpha**2 * between[rows, best] <= away] = np.inf
        alive[rows, best] = np.inf
    return kept


def searched(x, norms, graph, start: int, queries: np.ndarray, beam: int, width: int = 4):
    """The nodes (nearest first, -1: none) found from the start for each query."""
    count = len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(x)), bool)
    seen[:, start] = True
    ids = np.full((count, beam), -1, np.int32)
    far = np.full((count, beam), np.inf, np.float32)
    done = np.zeros((count, beam), bool)
    ids[:, 0] = start
    far[:, 0] = norms[start] - 2 * queries @ x[start]
    while True:
        open_ = ~done & (ids >= 0)
        if not open_.any():
            return ids
        turn = np.argsort(~open_, axis=1, kind="stable")[:, :width]
        use = np.take_along_axis(open_, turn, axis=1)
        np.put_along_axis(done, turn, True, axis=1)
        expanded = np.where(use, np.take_along_axis(ids, turn, axis=1), -1)
        near = np.where(expanded[:, :, None] >= 0, graph[expanded], -1).reshape(count, -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows, near]
        at, place = np.nonzero(fresh)
        node = near[at, place]
        seen[at, node] = True
        distance = np.full(near.shape, np.inf, np.float32)
        distance[at, place] = norms[node] - 2 * np.einsum("ij,ij->i", x[node], queries[at])
        near[~fresh] = -1
        ids = np.concatenate([ids, near.astype(np.int32)], axis=1)
        far = np.concatenate([far, distance], axis=1)
        done = np.concatenate([done, np.zeros(near.shape, bool)], axis=1)
        order = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.take_along_axis(far, order, axis=1).argsort(axis=1), 1)
        ids, far, done = (np.take_along_axis(part, order, axis=1) for part in (ids, far, done))


def built(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
    """The graph of the points (a row of neighbours each, -1: none) and where searches start."""
    count = len(x)
    norms = (x**2).sum(axis=1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(count)
    graph = np.full((count, degree), -1, np.int32)
    if count <= degree + 1:
        for node in range(count):
            graph[node, : count - 1] = np.delete(np.arange(count), node)
        return graph, start
    graph[:] = rng.integers(0, count, (count, degree))
    for factor in (1.0, alpha):
        order = rng.permutation(count)
        for begin in range(0, count, BLOCK):
            nodes = order[begin : begin + BLOCK]
            found = searched(x, norms, graph, start, x[nodes], beam)
            graph[nodes] = pruned(
                x, nodes, np.concatenate([found, graph[nodes]], axis=1), degree, factor
            )
            target = graph[nodes].ravel()
            source = np.repeat(nodes, degree)[target >= 0]
            _backwards(x, graph, target[target >= 0], source, factor)
    return graph, start


def _backwards(x, graph, target, source, alpha):
    """Add the edges target -> source, pruning where there is no room."""
    degree = graph.shape[1]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    for begin in range(0, len(nodes), BLOCK):
        part = slice(begin, begin + BLOCK)
        own, most = nodes[part], int(times[part].max())
        more = np.full((len(own), most), -1, np.int32)
        at = np.repeat(np.arange(len(own)), times[part])
        low = first[part][0]
        place = np.arange(len(at)) - np.repeat(first[part] - low, times[part])
        more[at, place] = source[low : low + len(at)]
        graph[own] = pruned(x, own, np.concatenate([graph[own], more], axis=1), degree, alpha)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return given.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        ~bad & F.exists("v", lambda e: e != 0)
    )


def nodes(vectors: DataFrame, k: int = K) -> DataFrame:
    """node (the smallest id), v and the k + 1 smallest ids of each different vector. The ids are
    cut in tasks, then per salt, then per vector: no list grows with the number of copies."""

    def local(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy() + 0.0
            sizes = lists.value_lengths().to_numpy()
            held: dict[bytes, list[int]] = {}
            for own, end, size in zip(ids.tolist(), np.cumsum(sizes).tolist(), sizes.tolist()):
                held.setdefault(flat[end - size : end].tobytes(), []).append(own)
            rows = [(np.frombuffer(key), sorted(set(own))[: k + 1]) for key, own in held.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([v for v, _ in rows], pa.list_(pa.float64())),
                    pa.array([own for _, own in rows], pa.list_(pa.int64())),
                ],
                names=["v", "ids"],
            )

    few = F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("ids")))), 1, k + 1)
    found = vectors.mapInArrow(local, "v array<double>, ids array<long>")
    found = found.withColumn("salt", F.spark_partition_id() % 32)
    found = found.groupBy("v", "salt").agg(few.alias("ids")).groupBy("v").agg(few.alias("ids"))
    return found.select(F.col("ids")[0].alias("node"), "v", "ids")


def _points(v: pa.Array, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, and the points they stand for."""
    x = v.flatten().to_numpy().reshape(len(v), -1)
    rest = np.sqrt(np.maximum(0.0, longest - (x**2).sum(axis=1)))
    return x, np.hstack([x, rest[:, None]]).astype(np.float32)


def graphs(found: DataFrame, longest: float, shard: int = SHARD) -> DataFrame:
    """One row for each shard: its nodes, their vectors, and the graph."""
    sized = found.withColumn("d", F.size("v"))
    counts = sized.groupBy("d").agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / shard)
    dealt = sized.join(F.broadcast(counts), "d").select(
        "d", F.pmod(F.xxhash64("node"), shards).alias("shard"), "node", "v", "ids"
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        _, x = _points(table.column("v").combine_chunks(), longest)
        graph, start = built(x)
        return pa.table(
            {
                "d": table.column("d")[:1],
                "shard": table.column("shard")[:1],
                "start": pa.array([start], pa.int64()),
                "graph": pa.array([graph.tobytes()], pa.binary()),
                "node": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
                "v": pa.array([table.column("v").combine_chunks().flatten()], pa.list_(pa.float64())),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return dealt.groupBy("d", "shard").applyInArrow(
        build,
        "d int, shard long, start long, graph binary, node array<long>, v array<double>, "
        "ids array<array<long>>",
    )


def nearest(
    vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, beam: int = BEAM
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each vector whose id is divisible
    by `every`, among all others."""
    given = valid(vectors)
    found = written(nodes(given, k), "nodes")
    longest = found.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda total, e: total + e * e))
    ).head()[0]
    index = written(graphs(found, longest or 0.0, shard), "graphs")

    asked = given.where(F.pmod("vec_id", F.lit(every)) == 0)
    key = F.xxhash64("v")
    asked = asked.withColumn("k", key).join(
        found.select("node", F.col("v").alias("w"), key.alias("h")),
        F.expr("k = h AND v = w"),
    )
    asked = written(asked.select("vec_id", "node").distinct(), "asked")
    queries = found.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v")
    blocks = max(1, -(-queries.count() // QUERIES))
    places = index.select("d", "shard").withColumnRenamed("d", "e")
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    lists = places.groupBy("e").agg(F.collect_list("shard").alias("shards"))
    dealt = dealt.withColumn("d", F.size("v")).join(F.broadcast(lists), F.expr("d = e"))
    dealt = dealt.select("d", F.explode("shards").alias("shard"), "block", "node", "v")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    index = index.withColumnsRenamed({"d": "e", "shard": "s", "block": "b"})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {"query": [], "node": [], "score": [], "ids": []}
        if left.num_rows and right.num_rows:
            held = right.column("node")[0].values.to_numpy()
            ids = right.column("ids")[0].as_py()
            original = right.column("v")[0].values.to_numpy().reshape(len(held), -1)
            rest = np.sqrt(np.maximum(0.0, longest - (original**2).sum(axis=1)))
            x = np.hstack([original, rest[:, None]]).astype(np.float32)
            norms = (x**2).sum(axis=1)
            graph = np.frombuffer(right.column("graph")[0].as_py(), np.int32).reshape(len(held), -1)
            start = right.column("start")[0].as_py()
            query = left.column("node").to_numpy()
            q = left.column("v").combine_chunks().flatten().to_numpy().reshape(len(query), -1)
            for begin in range(0, len(query), BLOCK):
                part = q[begin : begin + BLOCK]
                points = np.hstack([part, np.zeros((len(part), 1))]).astype(np.float32)
                places = searched(x, norms, graph, start, points, max(beam, k + 1))
                at, place = np.nonzero(places >= 0)
                node = places[at, place]
                score = (original[node] * part[at]).sum(axis=1)
                order = np.lexsort((held[node], -score, at))
                at, node, score = at[order], node[order], score[order]
                first = np.searchsorted(at, np.arange(len(part)))
                top = np.arange(len(at)) - first[at] <= k
                columns["query"].append(query[begin + at[top]])
                columns["node"].append(held[node[top]])
                columns["score"].append(score[top])
                columns["ids"] += [ids[n] for n in node[top].tolist()]
        none = [np.zeros(0, np.int64)]
        return pa.table(
            {
                "query": pa.array(np.concatenate(columns["query"] or none), pa.int64()),
                "node": pa.array(np.concatenate(columns["node"] or none), pa.int64()),
                "score": pa.array(np.concatenate(columns["score"] or none), pa.float64()),
                "ids": pa.array(columns["ids"], pa.list_(pa.int64())),
            }
        )

    answers = (
        dealt.groupBy("d", "shard", "block")
        .cogroup(index.groupBy("e", "s", "b"))
        .applyInArrow(search, "query long, node long, score double, ids array<long>")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    answers = answers.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = answers.select("query", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # One list per different query vector, of which each row with that vector leaves out itself.
    answers = answers.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("answers")
    )
    own = asked.join(answers, F.col("node") == F.col("query")).select(
        F.col("vec_id").alias("query_id"),
        F.slice(
            F.filter("answers", lambda one: one["id"] != F.col("vec_id")), 1, k
        ).alias("answers"),
    )
    own = own.select("query_id", F.posexplode("answers").alias("at", "one"))
    return own.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("one.id").alias("vec_id"),
        F.col("one.score").alias("score"),
    )
