"""N-gram Jaccard join by a token-group matrix: all links between texts with enough shingles in common.

The set of a text holds the hashes of its distinct 5-word shingles (fewer words: the sequence as
one shingle). Texts with equal sets are one class; classes link when 100 * intersection >=
percent * union.

1. *Order.* Sets are read in one total order: shingles that fewer than `HOT` texts hold first, by
   hash, then the others. Two sets that link share a shingle within their prefixes of
   n - ceil(percent * n / 100) + 1 shingles, and at least
   ceil(percent * (n + m) / (100 + percent)) - max(rest of n, rest of m) of them.
2. *Groups.* Of the classes that share a prefix shingle each is compared with the first one only:
   as many comparisons as rows. What links is put in groups of similar documents.
3. *Matrix.* Per rare shingle the groups whose union holds it, with the sizes of their members. A
   query counts its prefix shingles in each other group; only groups where the count reaches the
   bound above for some member's size are opened, and their members compared with the query in full.
   Classes that share a frequent prefix shingle are counted by matrix products of blocks instead.

So no comparison is made inside a group, where everything is connected already, and none between
texts that share only frequent passages. The order is free for the result: another `HOT` only
changes how many comparisons are made. The frequent shingles that tasks must know are at most
`MOST_HOT`; the count that makes a shingle frequent rises until they are.

Null and empty texts, and texts without words, have empty sets and link with nothing. Rows without
doc_id link with nothing and have no component. Repeated rows come back as often as they are given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import quoted
from tableview.llm.graph import components
from tableview.llm.tables import discard, received, sent, written
from tableview.llm.texts import SPACED, Words, annotate, chunks, mixed, sequences

SHINGLE = 5
PERCENT = 75
HOT = 50
MOST_HOT = 1 << 21
#: Classes in a block of comparisons.
CELL = 1_024
#: Ids sent to all tasks rather than joined by a shuffle.
MOST_SENT = 500_000


class Sets:
    """The sets of the texts of a chunk: sorted distinct hashes, row by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, SPACED)
        rows, values = [], []
        for length in range(1, SHINGLE + 1):
            firsts = words.within(length)
            of = words.rows()[firsts]
            if length < SHINGLE:
                exact = words.counts[of] == length
                firsts, of = firsts[exact], of[exact]
            rows.append(of)
            values.append(sequences(words.hashes, length)[firsts])
        rows, values = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            values[low:high].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        self.rows, self.values = rows[new], values[new]
        self.bounds = np.searchsorted(self.rows, np.arange(len(offsets)))
        self.counts = np.diff(self.bounds)

    def keys(self) -> np.ndarray:
        """A hash of each whole set."""
        sums = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(mixed(self.values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        return mixed(total + self.counts.astype(np.uint64)).view(np.int64)

    def places(self) -> np.ndarray:
        """Of each hash in its row."""
        return np.arange(len(self.values)) - self.bounds[:-1][self.rows]

    def blobs(self, chosen: np.ndarray) -> list[bytes]:
        picked = self.values[chosen]
        ends = np.concatenate([[0], np.cumsum(chosen)])[self.bounds]
        return [picked[low:high].tobytes() for low, high in zip(ends[:-1], ends[1:])]


def needed(counts, percent: int):
    """ceil(percent * counts / 100): the least a set that links shares with another."""
    return -(-percent * counts // 100)


def needed_overlap(n, m, percent: int):
    """The least that two sets of these sizes share if they link."""
    return -(-percent * (n + m) // (100 + percent))


def _split(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tokens by bucket, and the bounds of each bucket in it."""
    of = (tokens >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(of.astype(np.uint32), kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _short(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The name under which a token is counted: its bucket and its lower 32 bits."""
    return ((tokens >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (
        tokens & np.uint64(0xFFFFFFFF)
    )


def _frequent(docs: DataFrame, buckets: int, hot: int, most_hot: int) -> np.ndarray:
    """Short names of the tokens that `hot` texts or more hold."""

    def count(batches):
        for _, data, offsets in chunks(batches, "text"):
            sets = Sets(data, offsets)
            order, bounds = _split(sets.values, buckets)
            low = (sets.values & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets), pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ],
                names=["bucket", "tokens"],
            )

    def often(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32)
        seen, times = np.unique(tokens, return_counts=True)
        keep = times >= hot
        bucket = table.column("bucket")[0].as_py() << 32
        return pa.table(
            {
                "token": pa.array(seen[keep].astype(np.int64) | bucket),
                "times": pa.array(times[keep], pa.int64()),
            }
        )

    counted = docs.mapInArrow(count, "bucket long, tokens binary")
    counted = counted.groupBy("bucket").applyInArrow(often, "token long, times long")
    counted = written(counted, "frequent")
    if counted.count() > most_hot:
        tops = counted.groupBy("times").count().orderBy(F.desc("times"))
        total, least = 0, None
        for row in tops.toLocalIterator():
            total += row["count"]
            if total > most_hot:
                break
            least = row.times
        counted = counted.where(F.col("times") >= least if least else F.lit(False))
    return np.sort(counted.select("token").toArrow().column(0).to_numpy()).astype(np.uint64)


def _prefixes(docs: DataFrame, frequent: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """doc_id, n, key, and the prefix: rare tokens as bytes, frequent ones as a list."""
    shared = sent(docs.sparkSession, frequent)

    def prepare():
        known = received(shared)

        def compute(batch, data, offsets):
            sets = Sets(data, offsets)
            hot = np.zeros(len(sets.values), bool)
            if len(known):
                short = _short(sets.values, buckets)
                hot = known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
            upto = np.concatenate([[0], np.cumsum(hot)])
            before = upto[:-1] - upto[sets.bounds[:-1]][sets.rows]
            place = sets.places()
            reach = sets.counts - needed(sets.counts, percent) + 1
            rare_count = sets.counts - np.diff(upto[sets.bounds])
            rare = ~hot & (place - before < reach[sets.rows])
            often = hot & (before < (reach - rare_count)[sets.rows])
            lists = [
                np.frombuffer(blob, np.int64) if blob else None for blob in sets.blobs(often)
            ]
            return [
                pa.array(sets.counts, pa.int64()),
                pa.array(sets.keys(), pa.int64()),
                pa.array(sets.blobs(rare), pa.binary()),
                pa.array(lists, pa.list_(pa.int64())),
            ]

        return compute

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("rare", T.BinaryType()),
        T.StructField("often", T.ArrayType(T.LongType())),
    ]
    return annotate(docs, "text", fields, prepare, keep=["doc_id"])


_LISTED = "token long, key long, n long, leader long, leader_n long, frequent boolean"


def _lists(prefixes: DataFrame, buckets: int) -> DataFrame:
    """(token, key, n, leader, leader_n, frequent) for the prefix tokens of more than one class.

    Rare tokens are few times each, so that a bucket of them is as even as a hash; frequent ones
    are grouped by Spark. A frequent token is led by the class whose frequent tokens are the most
    frequent ones: the most typical of its copies.
    """

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(2).to_pylist()
            tokens = np.frombuffer(b"".join(blobs), np.uint64)
            sizes = [len(blob) // 8 for blob in blobs]
            key = np.repeat(batch.column(1).to_numpy(), sizes)
            n = np.repeat(batch.column(0).to_numpy(), sizes).astype(np.uint32)
            order, bounds = _split(tokens, buckets)
            tokens, key, n = tokens[order], key[order], n[order]
            parts = list(zip(bounds, bounds[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets), pa.int64()),
                    *(
                        pa.array([part[a:b].tobytes() for a, b in parts], pa.binary())
                        for part in (tokens, key, n)
                    ),
                ],
                names=["bucket", "tokens", "keys", "ns"],
            )

    def shared(table: pa.Table) -> pa.Table:
        def whole(name, kind):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        tokens, keys, ns = whole("tokens", np.uint64), whole("keys", np.int64), whole("ns", np.uint32)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        several = np.zeros(len(tokens), bool)
        several[1:] |= same
        several[:-1] |= same
        order, tokens = order[several], tokens[several]
        keys, ns = keys[order], ns[order].astype(np.int64)
        order = np.lexsort((keys, tokens))
        tokens, keys, ns = tokens[order], keys[order], ns[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys, ns = tokens[new], keys[new], ns[new]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        lead = np.flatnonzero(first)
        sizes = np.diff(np.append(lead, len(tokens)))
        lead, keep = np.repeat(lead, sizes), np.repeat(sizes, sizes) > 1
        columns = (tokens.view(np.int64), keys, ns, keys[lead], ns[lead])
        names = ("token", "key", "n", "leader", "leader_n")
        columns = {name: pa.array(column[keep]) for name, column in zip(names, columns)}
        return pa.table({**columns, "frequent": pa.array(np.zeros(int(keep.sum()), bool))})

    rare = prefixes.where("octet_length(rare) > 0").select("n", "key", "rare")
    rare = rare.mapInArrow(deal, "bucket long, tokens binary, keys binary, ns binary")
    rare = rare.groupBy("bucket").applyInArrow(shared, _LISTED)
    often = prefixes.select(F.explode("often").alias("token"), "key", "n").distinct()
    table = often = written(often, "often")
    sizes = often.groupBy("token").agg(F.count("*").alias("several")).where("several > 1")
    often = often.join(sizes, "token")
    typical = often.groupBy("key").agg(F.sum("several").alias("typical"))
    lead = often.join(typical, "key").groupBy("token")
    lead = lead.agg(F.max(F.struct("typical", "key", "n")).alias("lead")).select(
        "token", F.col("lead.key").alias("leader"), F.col("lead.n").alias("leader_n")
    )
    often = often.join(lead, "token").select("token", "key", "n", "leader", "leader_n")
    listed = written(rare.union(often.withColumn("frequent", F.lit(True))), "lists")
    discard(table)
    return listed


def _least_shared(percent: int, n, m):
    """How many tokens the prefixes of sets of n and m hashes share at least if the sets link."""
    overlap = F.ceil(percent * (n + m) / (100 + percent))
    return F.greatest(
        F.lit(1), overlap - F.greatest(F.ceil(percent * n / 100), F.ceil(percent * m / 100)) + 1
    )


def _least_opening(percent: int, n: Column, low: Column, high: Column) -> Column:
    """The least a set shares with a group whose sizes lie between `low` and `high`. The ceilings
    let a size between them ask for one less than both ends."""
    ends = F.least(_least_shared(percent, n, low), _least_shared(percent, n, high))
    return F.greatest(F.lit(1), ends - 1)


def _fits(percent: int, n, m):
    """The sizes allow a link."""
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, compared in full."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = written(keys.join(classes, "key").select("key", "doc_id"), "wanted")
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    # A repeated id may stand for several texts: the key tells which is meant.
    given = docs.join(wanted.withColumnRenamed("key", "class"), "doc_id")

    def prepare():
        def compute(batch, data, offsets):
            sets = Sets(data, offsets)
            everything = np.ones(len(sets.values), bool)
            return [pa.array(sets.keys()), pa.array(sets.blobs(everything), pa.binary())]

        return compute

    fields = [T.StructField("key", T.LongType()), T.StructField("tokens", T.BinaryType())]
    sets = annotate(given.select("class", "text"), "text", fields, prepare, keep=["class"])
    sets = sets.where("class = key").dropDuplicates(["key"]).select("key", "tokens")
    sets = written(sets, "sets")
    cells = _cells(pairs)
    shipped = cells.select("cell", F.explode(F.array("a", "b")).alias("key")).distinct()
    shipped = shipped.join(sets, "key").select(F.col("cell").alias("place"), "key", "tokens")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {
            key: np.frombuffer(blob, np.uint64)
            for key, blob in zip(right.column("key").to_pylist(), right.column("tokens").to_pylist())
        }
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            one, other = own.get(a), own.get(b)
            if one is None or other is None:
                keep.append(False)
                continue
            places = np.minimum(np.searchsorted(other, one), len(other) - 1)
            common = int((other[places] == one).sum())
            keep.append(100 * common >= percent * (len(one) + len(other) - common))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    linked = cells.groupBy("cell").cogroup(shipped.groupBy("place"))
    linked = written(linked.applyInArrow(compare, "a long, b long"), "links")
    discard(sets, cells)
    return linked


def _cells(pairs: DataFrame) -> DataFrame:
    """The pairs with the cell in which they are compared. All pairs that hang together are one
    family; small families share cells, a bigger one has a cell for each two of its blocks. So a
    set travels once, or once for each block of its family, and no cell grows with a family."""
    families = components(pairs)
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    families = families.join(sizes, "component")
    blocks = F.ceil(F.col("size") / CELL)
    block = F.pmod(F.xxhash64("id"), blocks)
    families = written(families.select("id", "component", blocks.alias("m"), block.alias("at")), "at")
    few = max(1, families.count() // CELL)
    one = families.select(F.col("id").alias("a"), "component", "m", F.col("at").alias("i"))
    other = families.select(F.col("id").alias("b"), F.col("at").alias("j"))
    near = F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j"))
    cell = F.when(F.col("m") == 1, F.pmod(F.xxhash64("component"), F.lit(few))).otherwise(near)
    cells = pairs.join(one, "a").join(other, "b").select(cell.alias("cell"), "a", "b")
    cells = written(cells, "cells")
    discard(families)
    return cells


_CELLS = {"tokens": np.uint64, "keys": np.int64, "ns": np.uint32, "groups": np.int64}


def _counted(cells: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(key, n, other, shared, least, most): in how many rare tokens of a bucket the class meets
    the union of another group, and the sizes of the members it meets there."""

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(place).to_numpy() for place in range(4)]
            columns[0] = columns[0].view(np.uint64)
            order, bounds = _split(columns[0], buckets)
            parts = list(zip(bounds, bounds[1:]))
            columns = [column[order].astype(kind) for column, kind in zip(columns, _CELLS.values())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets), pa.int64()),
                    *(
                        pa.array([column[a:b].tobytes() for a, b in parts], pa.binary())
                        for column in columns
                    ),
                ],
                names=["bucket", *_CELLS],
            )

    def meet(table: pa.Table) -> pa.Table:
        tokens, keys, ns, groups = (
            np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
            for name, kind in _CELLS.items()
        )
        order = np.lexsort((groups, tokens))
        tokens, groups = tokens[order], groups[order]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts, len(tokens))[1:]
        mixed_lists = groups[starts] != groups[ends - 1]
        keys, ns, groups = keys[order].tolist(), ns[order].tolist(), groups.tolist()
        met: dict[tuple[int, int, int], list[int]] = {}
        for begin, end in zip(starts[mixed_lists].tolist(), ends[mixed_lists].tolist()):
            unions: dict[int, list[int]] = {}
            for at in range(begin, end):
                union = unions.setdefault(groups[at], [ns[at], ns[at]])
                union[0] = min(union[0], ns[at])
                union[1] = max(union[1], ns[at])
            for at in range(begin, end):
                n, own = ns[at], groups[at]
                for other, (least, most) in unions.items():
                    if own < other and 100 * n >= percent * least and 100 * most >= percent * n:
                        seen = met.setdefault((keys[at], n, other), [0, least, most])
                        seen[0] += 1
                        seen[1] = min(seen[1], least)
                        seen[2] = max(seen[2], most)
        names = ("key", "n", "other", "shared", "least", "most")
        rows = [(*who, *seen) for who, seen in met.items()]
        columns = zip(*rows) if rows else [()] * 6
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

    dealt = cells.select("token", "key", "n", "grp").mapInArrow(
        deal, "bucket long, tokens binary, keys binary, ns binary, groups binary"
    )
    return dealt.groupBy("bucket").applyInArrow(
        meet, "key long, n long, other long, shared long, least long, most long"
    )


def _crowded(cells: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of different groups that share a frequent prefix token and
    enough prefix tokens in all.

    Per token, blocks of at most `CELL` classes meet two by two; a task multiplies their
    class-token matrices and returns the pairs whose count reaches the bound, and only those.
    """
    crowds = cells.where("frequent").groupBy("token").agg(
        F.count("*").alias("m"), F.min("grp").alias("least"), F.max("grp").alias("most")
    )
    crowds = crowds.where("least < most").select("token", F.ceil(F.col("m") / CELL).alias("blocks"))
    members = cells.where("frequent").join(crowds, "token")
    keys = members.select("key").distinct()
    tokens = listed.join(keys, "key").groupBy("key").agg(F.collect_list("token").alias("tokens"))
    members = members.withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks")))
    members = members.select(
        "token", "key", "n", "grp", "at", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("to")
    )
    members = members.join(tokens, "key").select(
        "token", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at",
        "key", "n", "grp", "tokens",
    )

    def multiply(table: pa.Table) -> pa.Table:
        key, n, grp, at = (table.column(name).to_numpy() for name in ("key", "n", "grp", "at"))
        lists = table.column("tokens").combine_chunks()
        seen, places = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        rows = np.repeat(np.arange(len(key)), lists.value_lengths().to_numpy())
        often = np.bincount(places) > 1
        rank = np.cumsum(often) - 1
        rows, places = rows[often[places]], rank[places[often[places]]]
        one = np.flatnonzero(at == at.min())
        other = np.flatnonzero(at == at.max())
        shared = np.zeros((len(one), len(other)), np.float32)
        for begin in range(0, int(often.sum()), 4_096):
            part = (places >= begin) & (places < begin + 4_096)
            held = np.zeros((len(key), 4_096), np.float32)
            held[rows[part], places[part] - begin] = 1
            shared += held[one] @ held[other].T
        low, high = n[one][:, None], n[other][None, :]
        overlap = needed_overlap(low, high, percent)
        rest = np.maximum(needed(low, percent), needed(high, percent)) - 1
        fits = (100 * low >= percent * high) & (100 * high >= percent * low)
        apart = grp[one][:, None] != grp[other][None, :]
        a, b = np.nonzero(apart & fits & (shared >= np.maximum(1, overlap - rest)))
        a, b = key[one[a]], key[other[b]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    found = members.groupBy("token", "i", "j").applyInArrow(multiply, "a long, b long")
    return found.distinct()


def links(
    documents: DataFrame, percent: int = PERCENT, hot: int = HOT, most_hot: int = MOST_HOT
) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc_id, n, key of every document, and the pairs of classes (a, b) that
    connect all classes whose sets link."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = 4 * max(4, docs.rdd.getNumPartitions())
    frequent = _frequent(docs.select("text"), buckets, hot, most_hot)
    prefixes = written(_prefixes(docs, frequent, buckets, percent), "prefixes")
    listed = _lists(prefixes.where("n > 0 AND doc_id IS NOT NULL"), buckets)
    every = written(prefixes.select("doc_id", "n", "key"), "classes")
    discard(prefixes)
    classes = every.where("n > 0 AND doc_id IS NOT NULL")
    classes = classes.groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    n, m = F.col("n"), F.col("leader_n")
    stars = (
        listed.where((F.col("key") != F.col("leader")) & _fits(percent, n, m))
        .groupBy("key", "leader", "n", "leader_n")
        .count()
        .where(F.col("count") >= _least_shared(percent, n, m))
        .select(F.col("key").alias("a"), F.col("leader").alias("b"))
    )
    first = _linked(written(stars, "stars"), docs, classes, percent)
    groups = written(components(first), "groups")

    own = groups.select(F.col("id").alias("key"), F.col("component").alias("grp"))
    own = F.broadcast(own) if own.count() <= MOST_SENT else own
    cells = listed.select("token", "key", "n", "frequent").join(own, "key", "left")
    cells = cells.withColumn("grp", F.coalesce("grp", "key"))
    crowded = _crowded(cells, listed, percent)
    rare = cells.where("NOT frequent")
    low = F.greatest("least", F.ceil(percent * n / 100))
    high = F.least("most", F.floor(100 * n / percent))
    opened = (
        _counted(rare, buckets, percent)
        .groupBy("key", "n", "other")
        .agg(
            F.sum("shared").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        .where(F.col("shared") >= _least_opening(percent, n, low, high))
        .select("key", "n", "other")
    )
    opened = written(opened, "opened")
    inside = cells.groupBy("grp", "key").agg(F.min("n").alias("m"))
    inside = inside.select(F.col("grp").alias("other"), F.col("key").alias("b"), "m")
    pairs = opened.join(inside, "other").where(_fits(percent, n, F.col("m")))
    pairs = pairs.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
    pairs = written(pairs.union(crowded).distinct(), "opened")
    discard(listed, opened, groups)
    return every, first.union(_linked(pairs, docs, classes, percent))


def grouped(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    members, pairs = links(documents, **options)
    known = members.where("n > 0 AND doc_id IS NOT NULL")
    first = known.groupBy("key").agg(F.min("doc_id").alias("least"))
    whole = components(pairs).withColumnRenamed("id", "key")
    first = first.join(whole, "key", "left").withColumn("whole", F.coalesce("component", "key"))
    roots = first.groupBy("whole").agg(F.min("least").alias("component_id"))
    roots = first.join(roots, "whole").select("key", "component_id")
    # An id given for several texts joins their components.
    split = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    if not split.where("a < b").isEmpty():
        extra = known.join(split.where("a < b"), "doc_id").select("a", F.col("key").alias("b"))
        whole = components(pairs.union(extra)).withColumnRenamed("id", "key")
        first = known.groupBy("key").agg(F.min("doc_id").alias("least"))
        first = first.join(whole, "key", "left").withColumn("whole", F.coalesce("component", "key"))
        roots = first.groupBy("whole").agg(F.min("least").alias("component_id"))
        roots = first.join(roots, "whole").select("key", "component_id")
    roots = written(roots, "roots")
    found = members.join(roots.withColumnRenamed("key", "k"), F.expr("key = k AND n > 0"), "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"),
    )


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its own columns.
    Documents without words and rows without doc_id stay; repeated rows count as copies, of which
    one stays."""
    found = grouped(documents, **options)
    keep = found.where("component_id = doc_id").select("doc_id").distinct()
    id_type = documents.schema["doc_id"].dataType
    keep = keep.select(F.col("doc_id").cast(id_type))
    kept = documents.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    kept = kept.dropDuplicates(["doc_id"])
    return kept.union(documents.where("doc_id IS NULL")).select(*map(quoted, documents.columns))
