"""Licence scan by ordered signature rules.

Words are lower-cased runs of digits, a-z and characters beyond ASCII; a text is scanned as its
words with one blank between them, so punctuation and line breaks never hide a licence.

1. A keyword prefilter looks up the hashes of all words at once. Only the words around a keyword,
   `license_rules.SPAN` to each side, are ever searched; no rule matches more words than that, so
   nothing is missed and memory follows a stretch of keywords, not the text.
2. In such a window every rule whose words all stand there is searched by its regular expression.
3. Detections are resolved in the order of the rules' priorities: one that lies inside a detection
   already kept (of better or equal priority) is suppressed. Of equal intervals with equal priority
   the earlier rule stays.

The phrases of `license_rules.BASE` are rules of their own. Their places and labels are counted
before suppression, so they always stay.

Null and empty texts have no words and no detections. Rows are scanned one by one: repeated rows
give the same result each, rows without doc_id come back like any other. Texts of any length are
scanned whole. The score is the confidence of the best detection left, 0 without any.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableview.llm.license_rules import BASE, CONFIDENCE, RULES, SPAN, Rule
from tableview.llm.texts import ALPHANUMERIC, Hashes, Words, annotate, fresh

_FIELDS = {
    "n_words": T.LongType(),
    "n_base": T.LongType(),
    "first_word": T.LongType(),
    "last_word": T.LongType(),
    "base_labels": T.StringType(),
    "labels": T.StringType(),
    "score": T.DoubleType(),
    "n_detections": T.LongType(),
}
_ARROW = {
    T.LongType: pa.int64(),
    T.StringType: pa.string(),
    T.DoubleType: pa.float64(),
}
_DETECTIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("priority", T.IntegerType()),
        ]
    )
)
_ARROW_DETECTIONS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("first_word", pa.int64()),
            ("words", pa.int64()),
            ("priority", pa.int32()),
        ]
    )
)


class Scanner:
    """The rules, compiled and filed under the first word they need."""

    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for at, rule in enumerate(rules):
            self.by_word[rule.needs[0].encode()].append(at)
        self.needs = [[word.encode() for word in rule.needs[1:]] for rule in rules]

    @cached_property
    def patterns(self) -> list[re.Pattern]:
        return [re.compile(f"(?<= )(?:{rule.pattern})(?= )".encode()) for rule in self.rules]

    @cached_property
    def keywords(self) -> np.ndarray:
        """The hashes of the words that a search begins at, sorted."""
        words = list(self.by_word)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(word) for word in words])
        starts = np.concatenate([[0], ends[:-1]])
        return np.sort(Hashes(data).of(starts, ends))

    def places(self, words: Words) -> np.ndarray:
        """The words of a chunk that are keywords."""
        at = np.searchsorted(self.keywords, words.hashes)
        at[at == len(self.keywords)] = 0
        return np.flatnonzero(self.keywords[at] == words.hashes)

    def search(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, end, rule) of every place in a window where a rule matches."""
        text = b" " + b" ".join(words) + b" "
        present = set(words)
        starts = np.cumsum([1, *(len(word) + 1 for word in words)])
        found = []
        for word in present & self.by_word.keys():
            for at in self.by_word[word]:
                if all(need in present for need in self.needs[at]):
                    for match in self.patterns[at].finditer(text):
                        first = int(np.searchsorted(starts, match.start()))
                        end = int(np.searchsorted(starts, match.end()))
                        found.append((first, end, at))
        return found

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The detections that lie inside no other one of better or equal priority."""
        kept: list[tuple[int, int, int]] = []
        for priority in sorted({self.rules[at].priority for _, _, at in found}):
            level = [one for one in found if self.rules[one[2]].priority == priority]
            level.sort(key=lambda one: (one[0], -one[1], one[2]))
            starts = [first for first, _, _ in kept]
            reach = np.maximum.accumulate([end for _, end, _ in kept]) if kept else None
            own, furthest = [], -1
            for first, end, at in level:
                before = int(np.searchsorted(starts, first, side="right"))
                if end <= furthest or (before and reach[before - 1] >= end):
                    continue
                furthest = end
                own.append((first, end, at))
            kept = sorted(kept + own)
        return kept


def windows(places: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
    """The words around the places of one text, which has words begin to end."""
    if not len(places):
        return []
    lows = np.maximum(places - SPAN, begin)
    highs = np.minimum(places + SPAN + 1, end)
    cut = np.flatnonzero(lows[1:] > highs[:-1])
    return list(
        zip(
            lows[np.concatenate([[0], cut + 1])].tolist(),
            highs[np.concatenate([cut, [len(places) - 1]])].tolist(),
        )
    )


def _scanned(scanner: Scanner, data: np.ndarray, offsets: np.ndarray):
    """(words, base places with their rules, detections left) of each text of a chunk."""
    words = Words(data, offsets, ALPHANUMERIC)
    places = scanner.places(words)
    edges = np.searchsorted(places, words.bounds)
    plain = words.data.tobytes()
    for row in range(len(offsets) - 1):
        begin, end = int(words.bounds[row]), int(words.bounds[row + 1])
        base, left = [], []
        for low, high in windows(places[edges[row] : edges[row + 1]], begin, end):
            shown = [
                plain[first:last]
                for first, last in zip(words.starts[low:high], words.ends[low:high])
            ]
            shift = low - begin
            found = scanner.search(shown)
            base += [(first + shift, at) for first, _, at in found if scanner.rules[at].base]
            left += [(first + shift, last + shift, at) for first, last, at in scanner.resolved(found)]
        yield end - begin, base, left


def _labels(names) -> str:
    return ",".join(sorted(set(names)))


def summary(documents: DataFrame) -> DataFrame:
    """One row per document: its base places and labels, all labels and the score."""
    docs = documents.select("doc_id", "text")

    def prepare():
        scanner = Scanner()

        def compute(batch, data, offsets):
            rows = []
            for count, base, left in _scanned(scanner, data, offsets):
                labels = [scanner.rules[at].label for _, at in base]
                found = [scanner.rules[at] for _, _, at in left]
                rows.append(
                    (
                        count,
                        len(base),
                        min((first for first, _ in base), default=None),
                        max((first for first, _ in base), default=None),
                        _labels(labels),
                        _labels(labels + [rule.label for rule in found]),
                        max((CONFIDENCE[rule.priority] for rule in found), default=0.0),
                        len(left),
                    )
                )
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            return [
                pa.array(values, _ARROW[type(kind)])
                for values, kind in zip(columns, _FIELDS.values())
            ]

        return compute

    fields = [T.StructField(name, kind) for name, kind in _FIELDS.items()]
    return annotate(docs, "text", fields, prepare, keep=["doc_id"])


def detections(documents: DataFrame) -> DataFrame:
    """One row per detection left: the document's columns but the text, label, first word, number
    of words, priority. Clashing names of the document's columns stay; the new ones get an
    underscore before them."""
    shown = [name for name in documents.columns if name != "text"]
    (hidden,) = fresh(documents, "detections")

    def prepare():
        scanner = Scanner()

        def compute(batch, data, offsets):
            rows = [
                [
                    {
                        "label": scanner.rules[at].label,
                        "first_word": first,
                        "words": end - first,
                        "priority": scanner.rules[at].priority,
                    }
                    for first, end, at in left
                ]
                for _, _, left in _scanned(scanner, data, offsets)
            ]
            return [pa.array(rows, _ARROW_DETECTIONS)]

        return compute

    found = annotate(documents, "text", [T.StructField(hidden, _DETECTIONS)], prepare, keep=shown)
    names = fresh(documents, "label", "first_word", "words", "priority")
    fields = ["label", "first_word", "words", "priority"]
    one = F.explode(hidden).alias(hidden)
    given = [F.col("`" + name.replace("`", "``") + "`") for name in shown]
    return found.select(*given, one).select(
        *given, *(F.col(hidden)[field].alias(name) for field, name in zip(fields, names))
    )


__all__ = ["BASE", "Scanner", "detections", "summary"]
