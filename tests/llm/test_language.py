from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tableview.llm import language

DOCS = "doc_id long, text string, lang string, lang_pred string"


def brute_bits(training: list[bytes], text: bytes) -> float:
    """Code length by walking from the longest known context down."""
    counts = defaultdict(Counter)
    for own in training:
        padded = bytes(3) + own
        for at in range(3, len(padded)):
            for order in range(4):
                counts[order, padded[at - order : at]][padded[at]] += 1
    bits, padded = 0.0, bytes(3) + text
    for at in range(3, len(padded)):
        for order in (3, 2, 1, 0):
            seen = counts.get((order, padded[at - order : at]))
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if padded[at] in seen:
                bits += math.log2((total + kinds) / seen[padded[at]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force():
    training = {"a": ["der die das und", "ü und öd"], "b": ["the and of the", ""]}
    counts = {}
    for lang, texts in training.items():
        keys = []
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            keys.append(language.grams(data, np.array([0, len(data)])))
        seen, times = np.unique(np.concatenate(keys), return_counts=True)
        counts[lang] = (seen.astype(np.int64), times)
    model = language.Model(["a", "b"], counts)
    texts = ["the und", "", "öäü", "zzz", "d", "of the das"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = model.bits(data, offsets)
    for row, lang in enumerate("ab"):
        own = [text.encode() for text in training[lang]]
        wanted = [brute_bits(own, text.encode()) for text in texts]
        assert np.allclose(found[row], wanted, rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {row.doc_id: row.lang for row in docs.collect()}
    rows = language.summary(docs).collect()
    assert len(rows) == len(known)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows)
    held = [row for row in rows if row.held_out]
    assert sum(row.lang_pred == known[row.doc_id] for row in held) >= 0.98 * len(held)
    assert all(0 <= row.score <= 1 for row in rows)


def test_odd_texts(spark):
    docs = [(i, "the cat and the dog of the house " * 3, "en", None) for i in range(8)]
    docs += [(10 + i, "der hund und die katze im haus " * 3, "de", None) for i in range(8)]
    odd = [(50, None, "en", None), (51, "", "en", None), (52, "12 !? 3", "de", None)]
    odd += [(53, "Ω", None, None), (None, "the dog", "en", None), (54, "und " * 100_000, None, None)]
    frame = spark.createDataFrame(docs + odd + odd[-1:], DOCS)
    found = {row.doc_id: row for row in language.summary(frame).collect()}
    assert [found[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3
    assert [found[i].score for i in (50, 51, 52)] == [0.0] * 3
    assert found[53].lang_pred in ("de", "en") and found[54].lang_pred == "de"
    assert found[None].lang_pred == "en" and not found[None].held_out
    kept = language.accepted(frame)
    assert kept.columns == frame.columns
    ids = [row.doc_id for row in kept.collect()]
    assert not {50, 51, 52} & set(ids) and ids.count(54) == 2


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], DOCS)
    assert language.summary(none).count() == language.accepted(none).count() == 0
    rows = language.summary(spark.createDataFrame([(1, "abc", None, None)], DOCS)).collect()
    assert [(row.lang_pred, row.score) for row in rows] == [("und", 0.0)]
