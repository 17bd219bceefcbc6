"""Best-fit packing of documents into training sequences, with conflicts.

A sequence (bin) holds `capacity` words. A document longer than that fills whole bins with its
first pieces; what is left, or a shorter document, is one item. A bin never holds two documents
of one duplicate cluster (same words in the same order, ASCII case aside) and at most `per_source`
of one source. Each bin carries two bitmaps: a bit per repeated cluster, `per_source` bits per
source.

Items are dealt at random to shards of about `shard_items`, so one shard is a bounded task whatever
the data hold. In a shard the items come by falling size, then doc_id. Bins are kept in order of
what is left in them; the search starts at the first bin with room and goes on to its successors
until one is compatible: the tightest compatible bin. Only if there is none, a bin is opened.

Null and empty texts are items of no words. Null sources count as one source. Repeated rows are
items of one cluster. Nothing is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.llm.tables import written
from tableview.llm.texts import SPACED, Words, annotate, ordered

CAPACITY = 2_048
PER_SOURCE = 8
SHARD_ITEMS = 4_096

PACKED = (
    "bin_id long, place int, doc_id {id}, piece long, first_word long, n_words long, "
    "source string, cluster long"
)


def best_fit(
    sizes: list[int], sources: list, clusters: list[int], capacity: int, per_source: int
) -> list[int]:
    """The bin of each item, in the given order."""
    repeated = [cluster for cluster, times in Counter(clusters).items() if times > 1]
    cluster_bit = {cluster: 1 << bit for bit, cluster in enumerate(repeated)}
    source_bits = {source: bit * per_source for bit, source in enumerate(dict.fromkeys(sources))}
    open_bins: list[tuple[int, int]] = []
    in_bin: list[list[int]] = []
    chosen = []
    slots = (1 << per_source) - 1
    for size, source, cluster in zip(sizes, sources, clusters):
        own, shift = cluster_bit.get(cluster, 0), source_bits[source]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            held_clusters, held_sources = in_bin[open_bins[at][1]]
            if not held_clusters & own and held_sources >> shift & slots != slots:
                break
            at += 1
        if at < len(open_bins):
            left, bin_at = open_bins.pop(at)
        else:
            left, bin_at = capacity, len(in_bin)
            in_bin.append([0, 0])
        held = in_bin[bin_at]
        taken = held[1] >> shift & slots
        held[0] |= own
        held[1] |= (taken + 1) << shift
        insort(open_bins, (left - size, bin_at))
        chosen.append(bin_at)
    return chosen


def items(documents: DataFrame) -> DataFrame:
    """doc_id, source, number of words and duplicate cluster of every document."""

    def prepare():
        def compute(batch, data, offsets):
            words = Words(data, offsets, SPACED)
            return [
                pa.array(words.counts, pa.int64()),
                pa.array(ordered(words.hashes, words.bounds).view(np.int64)),
            ]

        return compute

    fields = [T.StructField("n", T.LongType()), T.StructField("cluster", T.LongType())]
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return annotate(docs, "text", fields, prepare, keep=["doc_id", "source"])


def packed(
    documents: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """A row for every piece: bin, place in the bin, document, piece, its words, source, cluster."""
    tagged = items(documents).withColumn("tag", F.monotonically_increasing_id())
    tagged = written(tagged, "items")
    shards = max(1, -(-tagged.count() // shard_items))
    dealt = tagged.withColumn("shard", F.pmod(F.xxhash64("tag"), F.lit(shards)))
    id_type = documents.schema["doc_id"].dataType
    schema = T._parse_datatype_string(PACKED.format(id=id_type.simpleString()))
    arrow_id = tagged.select("doc_id").limit(0).toArrow().schema.field(0).type

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster"))))
        rows.sort(key=lambda row: (-(row[2] % capacity), row[0] is None, row[0] or 0, row[3], row[2]))
        pieces, bins = [], 0
        for doc, source, n, cluster in rows:
            for piece in range(n // capacity):
                pieces.append((bins, doc, piece, piece * capacity, capacity, source, cluster))
                bins += 1
        rest = [row for row in rows if row[2] % capacity or not row[2]]
        places = best_fit(
            [row[2] % capacity for row in rest],
            [row[1] for row in rest],
            [row[3] for row in rest],
            capacity,
            per_source,
        )
        for place, (doc, source, n, cluster) in zip(places, rest):
            piece = n // capacity
            first = piece * capacity
            pieces.append((bins + place, doc, piece, first, n - first, source, cluster))
        seen: Counter = Counter()
        places = []
        for piece in pieces:
            places.append(seen[piece[0]])
            seen[piece[0]] += 1
        bin_at, doc, piece, first, n, source, cluster = map(list, zip(*pieces))
        return pa.table(
            {
                "bin_id": pa.array([(shard << 32) + at for at in bin_at], pa.int64()),
                "place": pa.array(places, pa.int32()),
                "doc_id": pa.array(doc, arrow_id),
                "piece": pa.array(piece, pa.int64()),
                "first_word": pa.array(first, pa.int64()),
                "n_words": pa.array(n, pa.int64()),
                "source": pa.array(source, pa.string()),
                "cluster": pa.array(cluster, pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(pack, schema)
