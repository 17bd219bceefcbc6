"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, a-z and characters beyond ASCII. Of the hashes of all
`GRAM` consecutive words, every `WINDOW - GRAM + 1` neighbours keep their minimum; a span of
`WINDOW` words shared by a document and an item therefore shares a kept hash at the same place
of the span. A hit is extended to the whole windows around it, which must agree word for word.
Items of fewer words are one window of their own length, and for those lengths every gram is kept.

1. The kept hashes of the benchmark and those of the documents, each once a document, are tables that
   are joined. The benchmark's side is dealt `SALTS` times, so that a hash that a third of the
   documents share is spread over as many tasks.
2. Documents with a shared hash give the windows around it, word for word, which are joined with the
   windows of the benchmark in the same way. What agrees is a hit.

Spark picks the way of each join by size: a small benchmark is sent to all tasks, a big one meets the
documents in a shuffle. Texts are shuffled only of documents with a shared hash, as long as there are
`MOST_SENT` of them at most, and beyond that all once. Nothing of either passes through the driver but
the lengths of short items.

Null and empty texts have no words. Items without id or without words take no part. Repeated rows
of documents are judged one by one; an item id given twice counts once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import quoted
from tableview.llm.tables import written
from tableview.llm.texts import ALPHANUMERIC, Words, annotate, chunks, fresh, sequences

WINDOW = 10
GRAM = 5
SALTS = 16
#: Documents with a shared hash whose names all tasks may know; beyond them all texts are shuffled.
MOST_SENT = 500_000

_SPANS = "array<struct<begin: long, end: long>>"
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def kept(grams: np.ndarray, firsts: np.ndarray, width: int) -> np.ndarray:
    """Places of the minimum of `grams` over each `width` neighbours from the places `firsts`."""
    if not len(firsts):
        return firsts
    least = np.argmin(np.stack([grams[firsts + step] for step in range(width)]), axis=0)
    return np.unique(firsts + least)


def _prints(words: Words, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the kept grams for windows of a length."""
    firsts = words.within(length)
    if length < window:
        return firsts, sequences(words.hashes, length)[firsts]
    grams = sequences(words.hashes, gram)
    places = kept(grams, firsts, window - gram + 1)
    return places, grams[places]


def _row() -> Column:
    """One document: its id and the digest of its text."""
    text = F.md5(F.coalesce("text", F.lit("")))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")
    )
    return items.where("item IS NOT NULL AND text IS NOT NULL")


def _benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item, length, words and prints of every window of the benchmark: the words joined by blanks,
    and the kept hashes of the item, which its first window carries."""

    def cut(batches):
        for batch, data, offsets in chunks(batches, "text"):
            found: tuple[list, ...] = ([], [], [], [])
            ids = batch.column(0).to_pylist()
            for at, item in enumerate(ids):
                own = data[offsets[at] : offsets[at + 1]]
                words = Words(own, np.array([0, len(own)]), ALPHANUMERIC)
                length = min(window, int(words.counts[0]))
                if not length:
                    continue
                prints = np.unique(_prints(words, length, window, gram)[1]).view(np.int64)
                for first in range(int(words.counts[0]) - length + 1):
                    row = item, length, words.text(first, first + length), [] if first else prints
                    for column, value in zip(found, row):
                        column.append(value)
            types = pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(found, types)],
                names=["item", "length", "words", "prints"],
            )

    schema = "item string, length int, words binary, prints array<long>"
    return _items(benchmark).mapInArrow(cut, schema)


def _document_prints(docs: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """row, length and hash of the kept hashes of documents, each once a document."""

    def cut(batches):
        for batch, data, offsets in chunks(batches, "text"):
            words = Words(data, offsets, ALPHANUMERIC)
            for length in lengths:
                places, hashes = _prints(words, length, window, gram)
                bounds = np.searchsorted(places, words.bounds)
                hashes = hashes.view(np.int64)
                lists = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([length] * len(lists), pa.int32()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["row", "length", "prints"],
                )

    prints = docs.mapInArrow(cut, "row string, length int, prints array<long>")
    return prints.select("row", "length", F.explode("prints").alias("hash"))


def _candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """row, first, length and words of the windows around shared hashes."""

    def cut(batches):
        for batch, data, offsets in chunks(batches, "text"):
            all_words = Words(data, offsets, ALPHANUMERIC)
            found: tuple[list, ...] = ([], [], [], [])
            for at, (row, shared) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            ):
                low, high = int(all_words.bounds[at]), int(all_words.bounds[at + 1])
                own = data[offsets[at] : offsets[at + 1]]
                words = Words(own, np.array([0, len(own)]), ALPHANUMERIC)
                for length in sorted({print_["length"] for print_ in shared}):
                    known = np.array(
                        [print_["hash"] for print_ in shared if print_["length"] == length]
                    )
                    places, hashes = _prints(words, length, window, gram)
                    places = places[np.isin(hashes.view(np.int64), known)]
                    reach = window - gram + 1 if length == window else 1
                    firsts = np.unique((places[:, None] - np.arange(reach)).ravel())
                    for first in firsts[(firsts >= 0) & (firsts <= high - low - length)].tolist():
                        value = row, first, length, words.text(first, first + length)
                        for column, part in zip(found, value):
                            column.append(part)
            types = pa.string(), pa.int64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(found, types)],
                names=["row", "first", "length", "words"],
            )

    return docs.mapInArrow(cut, "row string, first long, length int, words binary")


def _met(many: DataFrame, few: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """The join of documents' rows with rows of the benchmark, dealt over `salts` tasks a key."""
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = many.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return salted.join(dealt, [*keys, "salt"]).drop("salt")


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and touching spans as one."""
    joined: list[list[int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([begin, end])
    return [{"begin": begin, "end": end} for begin, end in joined]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, salts: int) -> DataFrame:
    """row, hits and items of the rows (row, text) that share a window with the benchmark."""
    windows = written(_benchmark_windows(benchmark, window, gram), "windows")
    lengths = [row.length for row in windows.select("length").distinct().collect()]
    prints = windows.select("length", F.explode("prints").alias("hash")).distinct()
    prints = written(prints, "prints")
    shared = _met(
        _document_prints(docs, sorted(lengths), window, gram), prints, ["length", "hash"], salts
    )
    shared = shared.groupBy("row").agg(F.collect_set(F.struct("length", "hash")).alias("shared"))
    shared = written(shared, "shared")
    if shared.count() <= MOST_SENT:
        docs = docs.join(F.broadcast(shared.select("row")), "row", "left_semi")
    near = _candidates(docs.join(shared, "row"), window, gram)
    items = windows.select("words", "item").distinct()
    span = F.struct(F.col("first").alias("begin"), F.expr("first + length").alias("end"))
    found = _met(near, items, ["words"], salts).groupBy("row").agg(
        F.collect_set(span).alias("hits"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )

    def merge(batches):
        for batch in batches:
            spans = [
                _joined([(span["begin"], span["end"]) for span in own])
                for own in batch.column(1).to_pylist()
            ]
            columns = [batch.column(0), pa.array(spans, _ARROW_SPANS), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "hits", "items"])

    return written(found.mapInArrow(merge, f"row string, hits {_SPANS}, items array<string>"), "hits")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    salts: int = SALTS,
    names: tuple[str, str, str] = ("n_words", "hits", "items"),
) -> DataFrame:
    """Every column of the documents, their number of words, the word spans [begin, end) that
    occur in the benchmark, and the sorted ids of the items they come from."""
    n_words, hits, items = names
    found = _hits(documents.select(_row().alias("row"), "text"), benchmark, window, gram, salts)
    row = fresh(documents, "row")[0]
    counted = annotate(
        documents.select(*map(quoted, documents.columns), _row().alias(row)),
        "text",
        [T.StructField(n_words, T.LongType())],
        lambda: lambda batch, data, offsets: [
            pa.array(Words(data, offsets, ALPHANUMERIC).counts, pa.int64())
        ],
    )
    result = counted.join(found.toDF(row, hits, items), row, "left")
    none = (F.array().cast(_SPANS), F.array().cast("array<string>"))
    filled = [F.coalesce(quoted(n), empty).alias(n) for n, empty in zip((hits, items), none)]
    return result.select(*map(quoted, documents.columns), quoted(n_words), *filled)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def summary(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, items, their digest, and whether any word is hit."""
    found = contamination(documents.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    names = tuple(fresh(documents, "n_words", "hits", "items"))
    found = contamination(documents, benchmark, names=names, **options)
    return found.where(F.size(names[1]) == 0).drop(*names)
