"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `ORDER` bytes. A byte costs log2((T + D) / c) bits
in the longest context where it was seen, c times among T bytes of D kinds; every longer context
that is known but lacks the byte costs an escape of log2((T + D) / D) bits first (method C, without
exclusion), and a byte seen nowhere costs 8 bits more. The statistics are frozen before any text is
scored, so a text's code length is a sum over its bytes. The shortest code names the language.

The trees are counted on Spark over whole texts of at most about `SAMPLE` labelled documents per
language, chosen by a hash of the id; that is the only bounded part. Every text is scored whole.

A null text, or one without a letter, is `und` with score 0; so is every text if nothing could be
learned. Ties go to the first language by name. A row without doc_id is never learned from and
counts as not held out. Repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.catalog import quoted
from tableview.llm.tables import received, sent
from tableview.llm.texts import annotate, chunks, fresh

ORDER = 3
SAMPLE = 2_000
UNKNOWN = "und"
#: Evidence of so many bytes sets the score: a longer text is not surer of its language.
SCORED_BYTES = 64
#: A text that costs more bits a byte is like no learned language.
MOST_BITS = 9.0

_MASK = [(1 << 8 * (order + 1)) - 1 for order in range(ORDER + 1)]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to each byte, oldest first; zeros before a text begins."""
    keys = data.astype(np.uint32)
    begins = np.repeat(offsets[:-1], np.diff(offsets))
    since = np.arange(len(data)) - begins
    for back in range(1, ORDER + 1):
        if back < len(data):
            earlier = data[:-back].astype(np.uint32)
            earlier[since[back:] < back] = 0
            keys[back:] |= earlier << np.uint32(8 * back)
    return keys


def trained(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the columns doc_id, text and lang."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = {row.lang: row["count"] for row in known.groupBy("lang").count().collect()}
    share = F.create_map(
        *[F.lit(part) for lang, n in counts.items() for part in (lang, min(1.0, sample / n))]
    )
    if not counts:
        return Model([], {})
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = known.where(draw < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        for batch, data, offsets in chunks(batches, "text"):
            langs = np.array(batch.column(1).to_pylist(), object)
            keys = grams(data, offsets)
            of = np.repeat(langs, np.diff(offsets))
            for lang in sorted(set(langs)):
                seen, times = np.unique(keys[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(seen), pa.string()),
                        pa.array(seen.astype(np.int64)),
                        pa.array(times),
                    ],
                    names=["lang", "gram", "n"],
                )

    table = (
        chosen.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    of, gram, n = (table.column(name).to_numpy() for name in ("lang", "gram", "n"))
    langs = sorted(set(of))
    return Model(langs, {lang: (gram[of == lang], n[of == lang]) for lang in langs})


class _Tree:
    """One language: per order the cost of each seen gram and the escape cost of each context."""

    def __init__(self, grams_seen: np.ndarray, times: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            keys, place = np.unique(grams_seen & _MASK[order], return_inverse=True)
            count = np.bincount(place, times)
            contexts, place = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(place, count), np.bincount(place)
            cost = np.log2((total + kinds)[place] / count)
            self.levels.append((keys, cost, contexts, np.log2((total + kinds) / kinds)))

    def escape(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, known, cost = self.levels[order]
        place = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[place] == contexts, cost[place], 0.0)

    def cost(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order < 0:
            return np.full(len(keys), 8.0)
        keys = keys & _MASK[order]
        known, cost, _, _ = self.levels[order]
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[place] == keys
        result = cost[place]
        if not found.all():
            rest = keys[~found]
            result[~found] = self.escape(order, rest >> 8) + self.cost(order - 1, rest)
        return result


class _Lookup:
    """Places of keys in a sorted list: one probe for most, a binary search for the others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, len(keys).bit_length() + 2)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.slots[self.slot(keys)]
        found = self.keys[place] == keys
        missed = np.flatnonzero(~found)
        if len(missed):
            again = np.searchsorted(self.keys, keys[missed])
            again = np.minimum(again, len(self.keys) - 1).astype(np.int32)
            place[missed] = again
            found[missed] = self.keys[again] == keys[missed]
        return place, found


class Model:
    """The frozen statistics of all languages, laid out for scoring."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        trees = [_Tree(*counts[lang]) for lang in langs]
        self.levels = []
        for order in range(ORDER + 1) if langs else ():
            keys = np.unique(np.concatenate([tree.levels[order][0] for tree in trees]))
            contexts = np.unique(keys >> 8)
            self.levels.append(
                (
                    _Lookup(keys.astype(np.uint32)),
                    np.stack([tree.cost(order, keys) for tree in trees]).astype(np.float32),
                    _Lookup(contexts.astype(np.uint32)),
                    np.stack([tree.escape(order, contexts) for tree in trees]).astype(np.float32),
                )
            )

    def costs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each byte in each language: a row for a language."""
        if order < 0:
            return np.full((len(self.langs), len(keys)), 8.0, np.float32)
        keys = keys & np.uint32(_MASK[order])
        grams_known, cost, contexts_known, escapes = self.levels[order]
        place, found = grams_known.find(keys)
        result = np.take(cost, place, axis=1)
        rest = np.flatnonzero(~found)
        if len(rest):
            lower = self.costs(keys[rest], order - 1)
            where, known = contexts_known.find(keys[rest] >> np.uint32(8))
            lower += np.take(escapes, where, axis=1) * known
            result[:, rest] = lower
        return result

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language: a row for a language."""
        costs = self.costs(grams(data, offsets))
        sums = np.zeros((len(self.langs), len(data) + 1))
        np.cumsum(costs, axis=1, dtype=np.float64, out=sums[:, 1:])
        return sums[:, offsets[1:]] - sums[:, offsets[:-1]]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def with_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""

    def counted(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    letters = counted(_ASCII_LETTER[data]) > 0
    for row in np.flatnonzero(~letters & (counted(data >= 128) > 0)):
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        letters[row] = any(char.isalpha() for char in text)
    return letters


def predictions(
    documents: DataFrame,
    model: Model,
    names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte"),
) -> DataFrame:
    """Every column of the documents, the language, its share of the evidence, and the shortest
    code length a byte."""
    shared = sent(documents.sparkSession, model)

    def prepare():
        model = received(shared)

        def compute(batch, data, offsets):
            letters = with_letters(data, offsets)
            size = np.maximum(np.diff(offsets), 1)
            if not model.langs:
                letters[:] = False
                bits = np.zeros((1, len(size)))
            else:
                bits = model.bits(data, offsets)
            best = np.argmin(bits, axis=0)
            least = bits[best, np.arange(len(size))]
            evidence = (bits - least) * np.minimum(1.0, SCORED_BYTES / size)
            score = 1.0 / np.exp2(-evidence).sum(axis=0)
            lang = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            return [
                pa.array(lang, pa.string()),
                pa.array(np.where(letters, score, 0.0)),
                pa.array(least / size),
            ]

        return compute

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    fields = [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    return annotate(documents, "text", fields, prepare)


def held_out() -> Column:
    """Documents no language is learned from."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return F.coalesce(part == 2, F.lit(False))


def summary(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = trained(documents.where(~held_out()).select("doc_id", "text", "lang"), sample)
    found = predictions(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


def accepted(documents: DataFrame, sample: int = SAMPLE, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents written in a learned language, with their own columns; the others go: no
    letter at all, or bytes that are like no language."""
    lang, score, bits = fresh(documents, "lang_pred", "score", "bits_per_byte")
    model = trained(documents.where(~held_out()).select("doc_id", "text", "lang"), sample)
    found = predictions(documents, model, (lang, score, bits))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(bits) <= most_bits)).select(
        *map(quoted, documents.columns)
    )
