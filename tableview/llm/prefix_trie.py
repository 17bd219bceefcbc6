"""The trie of conversations that begin with the same turns, by digests of blocks of turns.

A conversation is a sequence of turns (role, text); a node of depth d is a distinct sequence of the
first d turns, its members are the conversations that start with it.

1. A turn is a SHA-256 digest and a number of words; texts go no further. Its two 64-bit marks are
   hashes of digest and place. A sequence is known by its length and the exclusive ors of its
   turns' marks (128 bits), which add up block by block in any order of work.
2. `BLOCK` consecutive turns are a block. Conversations are grouped by the digest of all turns up
   to the end of a block: a group is one kind of block below one earlier block.
3. Only where several kinds follow the same block are their turns compared: the places inside these
   kinds are grouped again. Elsewhere every turn of a kind is a node with the kind's members.
4. Each node belongs to its smallest member. The smallest member of a kind stays that of some kind
   below it, down to its own end, so the sum over a subtree is, over the members of the kind, what
   belongs to each of them from there on: running sums along conversations, then one grouping.

Running numbers and sums along a conversation are taken in slots (`SLOT` turns or blocks) with the
totals of the slots before, so one endless conversation is spread over tasks; a hot prefix is only
ever grouped with partial sums. The ids that end at a node are joined in order by tasks that hold
one range of them each, and hashed as a stream.

Turns are ordered by `turn` (null first), equal ones by digest. Null role and text are empty. Rows
without conv_id take no part. Turns given twice are two turns. Without any conversation there is no
node, not even the root.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableview.llm.tables import written

BLOCK = 4
#: Turns or blocks of one conversation that one task puts in order.
SLOT = 4_096
#: Characters of joined ids in one row.
PIECE = 1 << 20

#: A node is known by its depth and the two marks of its turns.
NODE = ["depth", "m1", "m2"]


# ---- turns ------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and words of every turn, in the order of `turn`."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # In the order of turn and digest; many turns without a number are told apart by digest.
    slot = F.struct(
        F.floor(F.col("turn") / SLOT).alias("t"),
        F.when(F.col("turn").isNull(), F.substring("digest", 1, 3)).alias("d"),
    )
    given = written(given.withColumn("slot", slot), "turns")
    sizes = given.groupBy("conv_id", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("conv_id", "slot").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = given.withColumn("own", F.row_number().over(own)).join(sizes, ["conv_id", "slot"])
    place = (F.col("before") + F.col("own")).alias("place")
    return placed.select("conv_id", place, "digest", "words")


def grafted(found: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, made from the turns of given ones: the ids, and turns.

    Conversation c takes its first h = crc32(c) % `heads` turns from c - c % `family` (all of them
    if it has fewer, none if there is no such conversation), then its own ones after its first h.
    """
    found = written(found, "placed")
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = found.groupBy("conv_id").agg(F.count("*").alias("n"))
    lengths = written(lengths.withColumns({"base": base, "h": h}), "lengths")
    bases = lengths.where("conv_id = base").select("base", F.col("n").alias("have"))
    taken = F.least("h", F.coalesce("have", F.lit(0)))
    ids = lengths.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"))
    ids = written(ids, "ids")
    first = found.where((F.col("conv_id") == base) & (F.col("place") < heads))
    first = first.withColumnRenamed("conv_id", "base")
    grafts = ids.where("taken > 0").join(first, "base").where("place <= taken")
    # The shift is the same for all turns of a conversation, so few rows meet the turns.
    moved = found.join(ids.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    place = (F.col("place") - F.col("h") + F.col("taken")).alias("place")
    all_turns = moved.select("conv_id", place, "digest", "words").union(
        grafts.select("conv_id", "place", "digest", "words")
    )
    return ids.select("conv_id"), all_turns


# ---- blocks -----------------------------------------------------------------------------


def _running(
    frame: DataFrame,
    key: str,
    order: str,
    sums: dict[str, str],
    total: Callable[[str], Column] = F.sum,
    add: Callable[[Column, Column], Column] = operator.add,
    backward: bool = False,
) -> DataFrame:
    """The frame with the totals, named as in `sums`, of its columns over the rows of the key up to
    this one (from this one on if `backward`), put together from slots of `SLOT` steps of the order.
    """
    direction = F.desc if backward else F.asc
    frame = frame.withColumn("slot", F.floor(F.col(order) / SLOT))
    start = Window.unboundedPreceding
    within = Window.partitionBy(key, "slot").orderBy(direction(order)).rowsBetween(start, 0)
    others = Window.partitionBy(key).orderBy(direction("slot")).rowsBetween(start, -1)
    slots = frame.groupBy(key, "slot").agg(*[total(c).alias(f"all_{n}") for n, c in sums.items()])
    far = [F.coalesce(total(f"all_{n}").over(others), F.lit(0)).alias(f"far_{n}") for n in sums]
    found = frame.withColumns({f"own_{n}": total(c).over(within) for n, c in sums.items()})
    found = found.join(slots.select(key, "slot", *far), [key, "slot"])
    both = {n: add(F.col(f"own_{n}"), F.col(f"far_{n}")) for n in sums}
    return found.withColumns(both).drop("slot", *[f"{w}_{n}" for w in ("own", "far") for n in sums])


def blocks(all_turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: its turns, and the node (depth, m1, m2) at its end."""
    marked = all_turns.select(
        "conv_id",
        "place",
        "words",
        F.floor((F.col("place") - 1) / block).alias("at"),
        F.xxhash64("place", "digest").alias("c1"),
        F.xxhash64("digest", F.lit("second"), "place").alias("c2"),
    )
    own = marked.groupBy("conv_id", "at").agg(
        F.bit_xor("c1").alias("x1"),
        F.bit_xor("c2").alias("x2"),
        F.max("place").alias("depth"),
        F.array_sort(F.collect_list(F.struct("place", "c1", "c2", "words"))).alias("turns"),
    )
    own = written(own, "blocks")
    marks = {"m1": "x1", "m2": "x2"}
    found = _running(own, "conv_id", "at", marks, F.bit_xor, Column.bitwiseXOR)
    start = {f"p{i}": F.col(f"m{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    return found.withColumns(start).drop("x1", "x2")


def _prefixes(kinds: DataFrame) -> DataFrame:
    """A row for each turn of a kind of block, with its node and the node before it."""
    inside = F.expr(
        "transform(turns, (t, i) -> named_struct('depth', t.place, 'words', t.words, "
        "'m1', aggregate(slice(turns, 1, i + 1), p1, (m, x) -> m ^ x.c1), "
        "'m2', aggregate(slice(turns, 1, i + 1), p2, (m, x) -> m ^ x.c2), "
        "'u1', aggregate(slice(turns, 1, i), p1, (m, x) -> m ^ x.c1), "
        "'u2', aggregate(slice(turns, 1, i), p2, (m, x) -> m ^ x.c2)))"
    )
    kept = ["at", "p1", "p2", "n", "least", "kind"]
    return kinds.select(*kept, F.explode(inside).alias("node")).select(*kept, "node.*")


# ---- the trie ---------------------------------------------------------------------------


def trie(ids: DataFrame, all_turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the conversations `ids` (conv_id) with these turns (conv_id, place, digest,
    words): smallest member, depth, parent, members, children, leaves and saved words below, and
    the hash of the ids that end there."""
    ids = written(ids, "ids")
    cut = written(blocks(all_turns, block), "cut")
    end = F.struct(*NODE)
    kinds = cut.groupBy("at", end.alias("kind")).agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        *[F.min(name).alias(name) for name in ("p1", "p2")],
        F.min("turns").alias("turns"),
    )
    kinds = written(kinds, "kinds")
    above = ["at", "p1", "p2"]
    branching = kinds.groupBy(*above).agg(F.count("*").alias("ways")).where("ways > 1")
    places = _prefixes(kinds).join(branching, above, "left")
    places = written(places.withColumn("split", F.col("ways").isNotNull()).drop("ways"), "places")
    plain = places.where("NOT split").select(*NODE, "u1", "u2", "n", "least", "words")
    met = places.where("split").groupBy(*NODE).agg(
        *[F.min(name).alias(name) for name in ("u1", "u2")],
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.min("words").alias("words"),
    )
    nodes = plain.union(met)
    below = nodes.groupBy((F.col("depth") - 1).alias("depth"), "u1", "u2").agg(
        F.count("*").alias("n_children")
    )
    below = below.withColumnsRenamed({"u1": "m1", "u2": "m2"})
    nodes = nodes.join(below, NODE, "left")
    nodes = written(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    gain = (F.col("all_n") - 1) * F.col("words")
    leaf = (F.col("n_children") == 0).cast("long")
    known = nodes.select(*NODE, F.col("n").alias("all_n"), F.col("least").alias("owner"), "n_children")
    mine = F.col("least") == F.col("owner")
    valued = places.select("at", "kind", "least", *NODE, "words").join(known, NODE)
    valued = valued.groupBy("at", "kind", "least").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *NODE,
                    F.when(mine, gain).otherwise(0).alias("gain"),
                    F.when(mine, leaf).otherwise(0).alias("leaf"),
                )
            )
        ).alias("inside")
    )
    both = {name: F.expr(f"aggregate(inside.{name}, 0L, (s, x) -> s + x)") for name in ("gain", "leaf")}
    valued = written(valued.withColumns(both), "valued")

    # What belongs to a conversation from a block on, summed over the members of the block's kind.
    owned = valued.select(F.col("least").alias("conv_id"), "at", "gain", "leaf")
    steps = cut.select("conv_id", "at", end.alias("kind")).join(owned, ["conv_id", "at"], "left")
    steps = steps.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("gain", "leaf")})
    sums = {"gains": "gain", "leaves": "leaf"}
    from_here = _running(steps, "conv_id", "at", sums, backward=True)
    under = from_here.groupBy("at", "kind").agg(
        F.sum("gains").alias("gains"), F.sum("leaves").alias("leaves")
    )
    spread = valued.join(under, ["at", "kind"]).withColumns(
        {"gains": F.col("gains") - F.col("gain"), "leaves": F.col("leaves") - F.col("leaf")}
    )
    inner = F.expr(
        "transform(inside, (v, i) -> named_struct('depth', v.depth, 'm1', v.m1, 'm2', v.m2, "
        "'saved', aggregate(slice(inside, i + 1, size(inside)), gains, (s, x) -> s + x.gain), "
        "'leaves', aggregate(slice(inside, i + 1, size(inside)), leaves, (s, x) -> s + x.leaf)))"
    )
    sums = spread.select(F.explode(inner).alias("v")).select("v.*").groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
    root = _root(ids, nodes, valued)
    shown = _with_parents(nodes, root).join(sums, NODE)
    columns = ["conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = shown.select(*columns).union(root.select(*columns))
    ends = end_hashes(ids, cut)
    none = hashlib.sha256(b"").hexdigest()
    return every.join(ends, NODE, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _with_parents(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """The nodes with the smallest member of their parent. The root, the parent of all nodes of
    depth 1, is a single row and sent to them."""
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("m1").alias("u1"),
        F.col("m2").alias("u2"),
        F.col("least").alias("parent_conv_id"),
    )
    deep = nodes.where("depth > 1").join(parents, ["depth", "u1", "u2"])
    top = root.select(
        F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    first = nodes.where("depth = 1").join(F.broadcast(top), "depth")
    return deep.unionByName(first).select(
        F.col("least").alias("conv_id"),
        *NODE,
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
    )


def _root(ids: DataFrame, nodes: DataFrame, valued: DataFrame) -> DataFrame:
    """The node without turns, of which every conversation is a member; none without any."""
    zero = F.lit(0).cast("long")
    parts = [
        ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")),
        nodes.where("depth = 1").agg(F.count("*").alias("n_children")),
        valued.agg(F.sum("gain").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    every = every.agg(
        *[
            F.coalesce(F.sum(name), zero).alias(name)
            for name in ("n_convs", "n_children", "saved_tokens")
        ],
        F.greatest(F.coalesce(F.sum("n_leaves"), zero), F.lit(1)).alias("n_leaves"),
        F.min("conv_id").alias("conv_id"),
    )
    marks = {name: zero for name in NODE}
    parent = F.lit(None).cast("long")
    return every.where("n_convs > 0").withColumns(marks | {"parent_conv_id": parent})


def end_hashes(ids: DataFrame, cut: DataFrame) -> DataFrame:
    """For each node at which conversations end: the SHA-256 of their ids, ascending, by commas.

    The ids are ranged over tasks by node and id, so a node with very many is joined in pieces by
    many of them; the last task of a node sees one piece at a time.
    """
    last = cut.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end"))
    zero = F.lit(0).cast("long")
    root = F.struct(*[zero.alias(name) for name in NODE])
    ended = ids.join(last, "conv_id", "left").select(
        F.coalesce("end", root).alias("end"), "conv_id"
    )
    ended = written(ended.select("end.*", "conv_id"), "ended")
    order = [*NODE, "conv_id"]
    ranged = ended.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = "depth long, m1 long, m2 long"
    pieces = ranged.mapInArrow(_joined, f"{keys}, first long, ids string")
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_hashed, f"{keys}, ends_sha256 string")


def _joined(batches):
    """Sorted ids as pieces of joined text, never more than `PIECE` characters and one id."""
    node, first, held, size = None, None, [], 0
    for batch in batches:
        done = []
        for depth, m1, m2, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if node != (depth, m1, m2) or size > PIECE:
                if held:
                    done.append((*node, first, ",".join(held)))
                node, first, held, size = (depth, m1, m2), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if done:
            yield _batch(done, ["depth", "m1", "m2", "first", "ids"])
    if held:
        yield _batch([(*node, first, ",".join(held))], ["depth", "m1", "m2", "first", "ids"])


def _hashed(batches):
    node, digest = None, None
    names = [*NODE, "ends_sha256"]
    for batch in batches:
        done = []
        for depth, m1, m2, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if node == (depth, m1, m2):
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = (depth, m1, m2), hashlib.sha256(ids.encode())
        if done:
            yield _batch(done, names)
    if node is not None:
        yield _batch([(*node, digest.hexdigest())], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=names)


def grafted_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the conversations as `grafted` makes them."""
    return trie(*grafted(turns(conversations), family, heads))
