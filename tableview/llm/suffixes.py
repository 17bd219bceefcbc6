"""Repeated byte strings, by suffix arrays built in two stages.

A string of `LENGTH` bytes that starts at two places of the corpus is repeated; every byte that a
repeated string covers goes. Texts are UTF-8 bytes; strings never cross texts.

1. *Anchors.* Of the hashes of the 32-byte grams in a string the smallest one, the leftmost of
   equals, is its anchor. Equal strings have equal anchors at the same place. Neighbouring strings
   with one anchor are a segment; only segments whose anchor occurs again can hold repeats.
2. *Copies.* Equal segments are one. A segment that occurs twice is repeated throughout.
3. *Suffix arrays.* The different segments of an anchor meet in one bucket of about `BUCKET` bytes,
   of which a task builds a suffix array; segments that share no half of a string with any other
   are left out first. Suffixes smaller than their successors are sorted
   directly; the others are induced by one scan over the buckets of first bytes. The common prefixes
   of neighbours then tell which strings are repeated.
4. An anchor with more than `CROWD` different segments, such as the edge of a passage that very many
   texts share, would outgrow a task. Its strings are counted by a 64-bit hash beside the anchor's.

Null texts are empty. Rows with the same doc_id and text are still different documents, so all their
long strings are repeated; rows without doc_id are documents like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableview.llm.tables import discard, received, sent, written
from tableview.llm.texts import Hashes, chunks, mixed

LENGTH = 200
GRAM = 32
BUCKET = 1 << 20
CROWD = 8_192
#: Rows sent to all tasks rather than joined by a shuffle.
MOST_SENT = 500_000


class Segments:
    """The segments of the texts of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.hashes = Hashes(data)
        sizes = np.diff(offsets)
        counts = np.maximum(0, sizes - length + 1)
        rows = np.repeat(np.arange(len(sizes)), counts)
        before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        starts = np.arange(len(rows)) - np.repeat(before - offsets[:-1], counts)
        if not len(starts):
            self.row = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.key = np.zeros(0, np.uint64)
            return
        places = np.arange(len(data) - gram + 1)
        grams = self.hashes.of(places, places + gram)
        least = (grams >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[starts], least[starts + width - reach])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(first)
        self.count = np.diff(np.append(first, len(at)))
        self.row, self.start = rows[first], starts[first]
        self.anchor = grams[at[first]]
        self.key = self.hashes.of(self.start, self.start + self.count + length - 1)


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


_FOUND = "row long, start long, n long, anchor long, key long"


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, start, n, anchor, key) of all segments."""

    def find(batches):
        for batch, data, offsets in chunks(batches, "text"):
            own = Segments(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own.row)),
                    pa.array(own.start - offsets[own.row]),
                    pa.array(own.count, pa.int64()),
                    pa.array(own.anchor.view(np.int64)),
                    pa.array(own.key.view(np.int64)),
                ],
                names=["row", "start", "n", "anchor", "key"],
            )

    return docs.select("row", "text").mapInArrow(find, _FOUND)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the text in the order of their first `depth` bytes, or a finer one.

    The text ends with its smallest byte. A suffix is smaller than its successor if the next
    different byte is greater than its first one.
    """
    size = len(text)
    step = np.zeros(size, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(size), size)
    known = np.minimum.accumulate(known[::-1])[::-1]
    rising = step[known] > 0
    whole = text.tobytes()
    direct = sorted(np.flatnonzero(rising).tolist(), key=lambda at: whole[at : at + depth])
    counts = np.bincount(text, minlength=256)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ends = heads + counts
    order = np.full(size, -1, np.int64)
    direct = np.array(direct, np.int64)
    first = text[direct]
    # Under one first byte the suffixes smaller than their successors come last.
    place = ends[first] - np.bincount(first, minlength=256)[first]
    rank = np.arange(len(direct)) - np.concatenate(
        [[0], np.cumsum(np.bincount(first, minlength=256))[:-1]]
    )[first]
    order[place + rank] = direct
    found, head = order.tolist(), heads.tolist()
    falls = (~rising).tolist()
    at = head[whole[size - 1]]
    found[at] = size - 1
    head[whole[size - 1]] = at + 1
    for suffix in found:
        before = suffix - 1
        if before >= 0 and falls[before]:
            byte = whole[before]
            at = head[byte]
            found[at] = before
            head[byte] = at + 1
    return np.array(found, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the next one in the order, up to `most`, found eight
    bytes at a time."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.zeros(len(text) + most + 8, np.uint64)
    for place in range(8):
        words = words << np.uint64(8) | padded[place : place + len(words)]
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(shared))
    for place in range(0, most, 8):
        differ = words[order[alive] + place] ^ words[order[alive + 1] + place]
        other = differ != 0
        ended, differ = alive[other], differ[other]
        same = np.zeros(len(ended), np.int64)
        for byte in range(1, 8):
            same += differ >> np.uint64(64 - 8 * byte) == 0
        shared[ended] = place + same
        alive = alive[~other]
        if not len(alive):
            break
    shared[alive] = most
    return np.minimum(shared, most)


def _repeated(segments: list[bytes], counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each segment the runs [from, to) of string starts that another segment holds too."""
    chosen = _sharing(segments, counts, length // 2)
    if not chosen.all():
        runs = iter(_repeated([s for s, c in zip(segments, chosen) if c], counts[chosen], length))
        return [next(runs) if own else [] for own in chosen]
    if not segments:
        return []
    # UTF-8 has no byte 255: one more leaves 0 for the ends of segments.
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    order = suffix_array(text, length)
    shared = common_prefixes(text, order, length) >= length
    marked = np.zeros(len(text) + 1, bool)
    marked[order[:-1][shared]] = True
    marked[order[1:][shared]] = True
    found, begin = [], 0
    for segment, count in zip(segments, counts.tolist()):
        own = marked[begin : begin + count]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        found.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
        begin += len(segment) + 1
    return found


def _sharing(segments: list[bytes], counts: np.ndarray, half: int) -> np.ndarray:
    """Which segments start a string with the same `half` bytes as another start in the bucket:
    the others cannot hold a repeated string and need no sorting."""
    sizes = np.array([len(segment) for segment in segments], np.int64)
    hashes = Hashes(np.frombuffer(b"".join(segments), np.uint8))
    of = np.repeat(np.arange(len(segments)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(len(of)) - np.repeat(first - (np.cumsum(sizes) - sizes), counts)
    _, place, times = np.unique(
        hashes.of(starts, starts + half), return_inverse=True, return_counts=True
    )
    chosen = np.zeros(len(segments), bool)
    chosen[of[times[place] > 1]] = True
    return chosen


_RUNS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
_VERDICT = "anchor long, key long, n long, runs array<struct<low: long, high: long>>"


def _sorted(different: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(anchor, key, n, runs) of the different segments, each of which one place is known."""
    piece = F.struct("start", "n", "anchor", "key")
    pieces = different.groupBy("row").agg(F.collect_list(piece).alias("pieces"))
    pieces = written(pieces.withColumnRenamed("row", "r"), "pieces")
    total = different.count()
    joined = pieces
    if pieces.count() <= MOST_SENT and total <= MOST_SENT:
        joined = F.broadcast(pieces)
    # Equal rows have equal texts: either of them gives the bytes.
    held = docs.join(joined, F.col("row") == F.col("r")).select("text", "pieces")

    def cut(batches):
        for batch, data, offsets in chunks(batches, "text"):
            rows = []
            for at, pieces in enumerate(batch.column(1).to_pylist()):
                base = offsets[at]
                for piece in pieces:
                    begin = base + piece["start"]
                    end = begin + piece["n"] + length - 1
                    rows.append((piece["anchor"], piece["key"], piece["n"], data[begin:end].tobytes()))
            if rows:
                anchor, key, n, segment = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in (anchor, key, n)]
                    + [pa.array(segment, pa.binary())],
                    names=["anchor", "key", "n", "segment"],
                )

    # Written before they are grouped: the shuffle files of the texts are gone by then.
    cuts = held.mapInArrow(cut, "anchor long, key long, n long, segment binary")
    cuts = written(cuts, "cuts", compression="zstd")
    segments = written(cuts.dropDuplicates(["anchor", "key", "n"]), "segments", compression="zstd")
    discard(pieces, cuts)
    size = segments.agg(F.sum(F.octet_length("segment"))).head()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    segments = segments.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))

    def sort(table: pa.Table) -> pa.Table:
        runs = _repeated(
            table.column("segment").to_pylist(), table.column("n").to_numpy(), length
        )
        runs = [[{"low": low, "high": high} for low, high in own] for own in runs]
        return table.select(["anchor", "key", "n"]).append_column("runs", pa.array(runs, _RUNS))

    verdicts = written(segments.groupBy("bucket").applyInArrow(sort, _VERDICT), "verdicts")
    discard(segments)
    return verdicts


def _counted(docs: DataFrame, crowds: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, low, high): the strings of crowded anchors that occur twice, counted by hash."""

    def expand(batches):
        for batch, data, offsets in chunks(batches, "text"):
            own = Segments(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own.row)),
                    pa.array(own.start - offsets[own.row]),
                    pa.array(own.anchor.view(np.int64)),
                    pa.array(_string_hashes(own, length), pa.list_(pa.int64())),
                ],
                names=["row", "start", "anchor", "strings"],
            )

    rows = docs.select("row", "text").mapInArrow(
        expand, "row long, start long, anchor long, strings array<long>"
    )
    few = crowds.count() <= MOST_SENT
    anchors = crowds.select("anchor")
    rows = written(rows.join(F.broadcast(anchors) if few else anchors, "anchor"), "strings")
    strings = rows.select("anchor", F.explode("strings").alias("string"))
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("times"))
    twice = written(twice.where("times > 1").select("anchor", "string"), "twice")
    if twice.count() > MOST_SENT:
        rows = rows.select("row", "start", "anchor", F.posexplode("strings").alias("at", "string"))
        rows = rows.join(twice, ["anchor", "string"])
        low = F.col("start") + F.col("at")
        return rows.select("row", low.alias("low"), (low + 1).alias("high"))
    # At most MOST_SENT repeated strings go to the tasks, which give their runs.
    known = {}
    for row in twice.toLocalIterator():
        known.setdefault(row.anchor, []).append(row.string)
    known = sent(docs.sparkSession, {a: np.array(strings) for a, strings in known.items()})

    def mark(batches):
        repeated = received(known)
        for batch in batches:
            found = []
            for row, start, anchor, strings in zip(*batch.columns):
                own = repeated.get(anchor.as_py())
                if own is None:
                    continue
                held = np.isin(strings.values.to_numpy(), own).view(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], held, [0]])))
                edges = (edges + start.as_py()).tolist()
                found += [(row.as_py(), a, b) for a, b in zip(edges[::2], edges[1::2])]
            columns = zip(*found) if found else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in columns], names=["row", "low", "high"]
            )

    rows = rows.select("row", "start", "anchor", "strings")
    return rows.mapInArrow(mark, "row long, low long, high long")


def _string_hashes(own: Segments, length: int) -> list[np.ndarray]:
    """The hashes of the strings of each segment."""
    ends = np.cumsum(own.count)
    starts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(
        own.start - (ends - own.count), own.count
    )
    values = mixed(own.hashes.of(starts, starts + length)).view(np.int64)
    return [values[end - count : end] for end, count in zip(ends, own.count)]


def repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> DataFrame:
    """row (a hash of doc_id and text) and the runs (low, high) of starts of repeated strings, of
    the documents that have any."""
    docs = documents.select(_row().alias("row"), "text")
    every = written(_segments(docs, length, gram), "segments", compression="zstd")
    again = every.groupBy("anchor").agg(F.count("*").alias("times"))
    # Written by itself: the shuffle files of the count are gone before those of the join come.
    again = written(again.where("times > 1").select("anchor"), "anchors")
    found = written(every.join(again, "anchor"), "again", compression="zstd")
    discard(every, again)
    kinds = found.groupBy("anchor", "key", "n").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "start")).alias("place")
    )
    kinds = written(kinds, "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    crowds = written(several.where(F.col("kinds") > crowd), "crowds")
    several = several.where(F.col("kinds") <= crowd)
    different = kinds.join(several, "anchor").select("anchor", "key", "n", "place.*")
    different = written(different, "different")
    sorted_runs = _sorted(different, docs, length)
    whole = kinds.where("times > 1").select(
        "anchor", "key", "n", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))).alias("runs"),
    )
    verdicts = whole.union(sorted_runs.where(F.size("runs") > 0))
    verdicts = written(verdicts.select("anchor", "key", "n", F.explode("runs").alias("run")), "runs")
    discard(kinds, different, sorted_runs)
    runs = found.join(verdicts, ["anchor", "key", "n"]).select(
        "row",
        (F.col("start") + F.col("run.low")).alias("low"),
        (F.col("start") + F.col("run.high")).alias("high"),
    )
    if not crowds.isEmpty():
        runs = runs.union(_counted(docs, crowds, length, gram))
    runs = runs.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    runs = written(runs, "repeats")
    discard(found, verdicts, crowds)
    return runs


def spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal byte spans that the strings starting in the runs cover."""
    joined: list[list[int]] = []
    for low, high in sorted((run["low"], run["high"]) for run in runs):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high + length - 1)
        else:
            joined.append([low, high + length - 1])
    return [(low, high) for low, high in joined]


def removed(documents: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, the spans [begin, end) of bytes that go, and the bytes that stay."""
    found = repeats(documents, length, **options).withColumnRenamed("row", "r")
    docs = documents.select("doc_id", _row().alias("row"), "text")
    held = docs.join(found.hint("shuffle_hash"), F.col("row") == F.col("r"), "left")
    held = held.select("doc_id", "text", "runs")
    id_type = documents.schema["doc_id"].dataType

    def remove(batches):
        for batch, data, offsets in chunks(batches, "text"):
            gone, kept = [], []
            for at, runs in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[at] : offsets[at + 1]]
                cut = spans(runs or [], length)
                gone.append([{"begin": low, "end": high} for low, high in cut])
                ends = [0, *(edge for span in cut for edge in span), len(own)]
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2])))
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(gone, pa.list_(span)),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    schema = (
        f"doc_id {id_type.simpleString()}, n_bytes long, "
        "removed array<struct<begin: long, end: long>>, kept binary"
    )
    return held.mapInArrow(remove, schema)


def summary(documents: DataFrame, **options) -> DataFrame:
    """One row per document: bytes, removed bytes, removed spans, digest of what stays."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return removed(documents.select("doc_id", "text"), **options).select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
