"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary documents, one on the passages
that make documents toxic. A window is compressed twice, knowing the ordinary dictionary alone and
knowing both; the bytes that the toxic one saves are the window's distance. A text's largest saving,
the mean of its three largest, its mean saving and its number of windows go into a logistic
calibration, whose 0.5 is the threshold.

Passages are runs of `GRAM`-byte strings that at least a share `SUPPORT` of the toxic documents
hold, `TELLING` times as often as ordinary ones. Strings, dictionaries and calibration are learned
from about `SAMPLE` labelled documents of each label at most, chosen by a hash of the id, three
quarters for the dictionaries and one for the calibration. Of a sampled ordinary document the dictionary
sees `EACH` windows, evenly spaced. Nothing else is bounded: every text is scored over all its windows.

Null and empty texts have one empty window. Labels that are null, or without doc_id or document, are
not learned from. Without documents of both labels every score is the share of toxic ones, 0 if there
are none. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.llm.tables import received, sent, written
from tableview.llm.texts import LOWER, annotate, chunks

SAMPLE = 4_000
EACH = 6
WINDOW = 64
STEP = 32
GRAM = 5
TELLING = 20
SUPPORT = 0.004
TOXIC_BYTES = 8 << 10
ORDINARY_BYTES = 16 << 10
LEVEL = 12


def _grams(data: np.ndarray) -> np.ndarray:
    """The strings of GRAM bytes as numbers, by first byte."""
    count = max(0, len(data) - GRAM + 1)
    total = np.zeros(count, np.int64)
    for place in range(GRAM):
        total = total << 8 | data[place : place + count]
    return total


def _gram_counts(sample: DataFrame) -> DataFrame:
    """gram, toxic and ordinary: the number of documents of each label that hold it."""

    def count(batches):
        for batch, data, offsets in chunks(batches, "text"):
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            found: dict[int, list] = {0: [], 1: []}
            for row in range(batch.num_rows):
                own = LOWER[data[offsets[row] : offsets[row + 1]]]
                found[int(toxic[row])].append(np.unique(_grams(own)))
            for label, parts in found.items():
                if parts:
                    seen, times = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seen), pa.array(times * label), pa.array(times * (1 - label))],
                        names=["gram", "toxic", "ordinary"],
                    )

    counted = sample.select("text", "toxic").mapInArrow(count, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )


def _passages(sample: DataFrame, telling: np.ndarray) -> DataFrame:
    """passage and n: the runs of telling strings in toxic documents."""
    shared = sent(sample.sparkSession, telling)

    def find(batches):
        known = received(shared)
        for _, data, offsets in chunks(batches, "text"):
            counted: Counter = Counter()
            for low, high in zip(offsets[:-1], offsets[1:]):
                own = LOWER[data[low:high]]
                places = np.flatnonzero(np.isin(_grams(own), known))
                if len(places):
                    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                        counted[own[run[0] : run[-1] + GRAM].tobytes()] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.binary()), pa.array(counted.values(), pa.int64())],
                names=["passage", "n"],
            )

    found = sample.where("toxic = 1").select("text").mapInArrow(find, "passage binary, n long")
    return found.groupBy("passage").agg(F.sum("n").alias("n"))


def _windows(sample: DataFrame, each: int = EACH) -> DataFrame:
    """Evenly spaced windows of ordinary documents."""

    def cut(batches):
        for _, data, offsets in chunks(batches, "text"):
            found = []
            for low, high in zip(offsets[:-1], offsets[1:]):
                own = LOWER[data[low:high]].tobytes()
                for at in np.unique(np.linspace(0, max(0, len(own) - WINDOW), each).astype(int)):
                    found.append(own[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["window"])

    return sample.where("toxic = 0").select("text").mapInArrow(cut, "window binary")


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; too few samples to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes, window: int, step: int):
        self.window, self.step = window, step
        self.alone, self.both = (
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                compression_params=zstandard.ZstdCompressionParameters.from_level(
                    LEVEL,
                    source_size=window,
                    dict_size=len(toxic) + len(ordinary),
                    min_match=3,
                    write_content_size=0,
                    write_dict_id=0,
                ),
            )
            for content in (ordinary, toxic + ordinary)
        )

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        alone, both, size = self.alone.compress, self.both.compress, self.window
        saved = []
        for at in range(0, max(1, len(text) - (size - self.step)), self.step):
            piece = text[at : at + size]
            saved.append(len(alone(piece)) - len(both(piece)))
        top = sorted(saved, reverse=True)[:3]
        return top[0], sum(top) / len(top), sum(saved) / len(saved), float(np.log(len(saved)))


def _with_features(frame: DataFrame, dictionaries: tuple[bytes, bytes], name: str) -> DataFrame:
    shared = sent(frame.sparkSession, dictionaries)

    def prepare():
        distance = Distance(*received(shared), WINDOW, STEP)

        def compute(batch, data, offsets):
            low = LOWER[data].tobytes()
            rows = [
                distance.features(low[a:b])
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            return [pa.array(rows, pa.list_(pa.float64()))]

        return compute

    field = T.StructField(name, T.ArrayType(T.DoubleType()))
    return annotate(frame, "text", [field], prepare, [c for c in frame.columns if c != "text"])


def calibrated(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the features and an intercept, by Newton steps on the log loss with a small
    penalty."""
    scale = features.std(axis=0) + 1e-9
    centre = features.mean(axis=0)
    x = np.hstack([(features - centre) / scale, np.ones((len(features), 1))])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + 0.1 * weights
        curvature = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curvature, gradient)
    plain = weights[:-1] / scale
    return np.append(plain, weights[-1] - plain @ centre)


def fitted(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE
) -> tuple[tuple[bytes, bytes], np.ndarray]:
    """The dictionaries (toxic, ordinary) and the calibration of labelled documents."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic")
    counts = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    toxic, ordinary = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not ordinary:
        share = 1.0 if toxic else 0.0
        return (b"", b""), np.array([0, 0, 0, 0, 50.0 * (2 * share - 1)])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    share = F.when(F.col("toxic") == 1, sample / toxic).otherwise(sample / ordinary)
    chosen = known.where(draw / 1_000_003 < share)
    docs = documents.where("text IS NOT NULL").select("doc_id", "text")
    chosen = docs.join(F.broadcast(chosen), "doc_id").withColumn("part", draw % 4)
    chosen = written(chosen.select("text", "toxic", "part"), "sample")
    learned = chosen.where("part > 0")
    sizes = {row.toxic: row["count"] for row in learned.groupBy("toxic").count().collect()}
    ratio = sizes.get(0, 0) / max(1, sizes.get(1, 0))
    telling = _gram_counts(learned).where(
        (F.col("toxic") >= max(3, SUPPORT * sizes.get(1, 0)))
        & (F.col("toxic") * ratio >= TELLING * (F.col("ordinary") + 1))
    )
    telling = telling.select("gram").toArrow().column(0).to_numpy()
    passages = _passages(learned, np.sort(telling)).orderBy(F.desc("n"), "passage").collect()
    repeated = [bytes(row.passage) for row in passages for _ in range(row.n)]
    ordinary_windows = [bytes(row.window) for row in _windows(learned).collect()]
    dictionaries = (
        _dictionary(repeated, TOXIC_BYTES),
        _dictionary(ordinary_windows, ORDINARY_BYTES),
    )
    rows = _with_features(chosen.where("part = 0"), dictionaries, "features").collect()
    if len({row.toxic for row in rows}) < 2:
        base = np.log(toxic / ordinary)
        return dictionaries, np.array([0, 0, 0, 0, base])
    found = calibrated(
        np.array([row.features for row in rows]), np.array([float(row.toxic) for row in rows])
    )
    # The sample is balanced by label as far as it goes; the intercept is put back to all labels.
    kept = np.array([min(1.0, sample / toxic), min(1.0, sample / ordinary)])
    found[-1] -= np.log(kept[0] / kept[1])
    return dictionaries, found


def held_out() -> Column:
    """Documents whose labels are not learned from."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    return F.coalesce(part == 0, F.lit(False))


def scored(documents: DataFrame, model: tuple[tuple[bytes, bytes], np.ndarray]) -> DataFrame:
    """doc_id and score of every document."""
    dictionaries, weights = model
    found = _with_features(documents.select("doc_id", "text"), dictionaries, "features")
    logit = F.lit(float(weights[-1]))
    for place, weight in enumerate(weights[:-1]):
        logit = logit + F.col("features")[place] * float(weight)
    return found.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def summary(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = fitted(documents, labels.where(~held_out()), sample)
    return scored(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
