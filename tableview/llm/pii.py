"""Personal data: fixed patterns, and the terms that give a person away.

*Patterns.* Addresses of mail and network, card and telephone numbers, leftmost and without
overlap for each kind; a match that fails its test (parts, digits, Luhn) is dropped, not retried.

*Terms.* The value of a match is a protected entity. A term stands with it if both are in a document;
documents are cut into parts of `PART` words, and in those of more than one part the term has to be in
the part of the entity or one beside it, so that the pairs grow with the text and not with its square.
Over the whole corpus of N documents, a term t that stands with entity e in n documents reveals
log2(n * N / (n_e * n_t)) of the -log2(n_e / N) bits that e holds. A share of `REMOVED` or more of any
entity and the term is removed, of `GENERALISED` or more and it is replaced by a class: at all its
places in all documents, also those without the entity, since the term gives it away there too. It
takes `SUPPORT` different texts, so that copies of a text count once. Terms are lower-cased runs of
digits, letters and characters beyond ASCII, `MIN_CHARS` long at least, outside the matches.

A share of s needs n_t <= n_e ** s * N ** (1 - s), whatever n is: other pairs are never built, and the
result is the same. Texts that are equal are one row with their number. Words in more than one of
`HOT` documents, whose number has a bound, are joined by a broadcast, all others by a shuffle.

Null and empty texts have no spans. Rows with the same doc_id and text are one document and get the
same spans; rows without doc_id are treated like others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableview.catalog import quoted
from tableview.llm.tables import received, sent, written
from tableview.llm.texts import ALPHANUMERIC, Words, chunks

KINDS = ("email", "ip", "card", "phone", "term_removed", "term_generalised")
PART = 1_000
MIN_CHARS = 4
SUPPORT = 3
REMOVED = 0.9
GENERALISED = 0.7
HOT = 1_000
#: Disclosing words that tasks know by themselves; beyond them all words go to the join.
MOST_SENT = 1_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_CAPITALS = {upper: upper + 32 for upper in range(65, 91)}


def _emails(text: str) -> list[tuple[int, int]]:
    """Each part between signs is read once: its end as a name, its start as a domain."""
    parts = text.split("@")
    found, at, free = [], 0, 0
    for before, after in zip(parts, parts[1:]):
        sign = at + len(before)
        name = before[max(0, free - at) :]
        size = len(name) - len(name.rstrip(_LOCAL))
        if size and (domain := _DOMAIN.match(after)):
            free = sign + 1 + domain.end()
            found.append((sign - size, free))
        at = sign + 1
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches, by start and kind; the kind is its place in KINDS."""
    found = []
    if "@" in text:
        found += [(start, 0, end) for start, end in _emails(text)]
    for match in _IP.finditer(text):
        if all(map(_part, match[0].split("."))):
            found.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _NO_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def _entity(text: str, start: int, kind: int, end: int) -> str:
    value = text[start:end]
    return f"{kind}:{value.translate(_CAPITALS) if kind < 2 else _NO_DIGIT.sub('', value)}"


def _free(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each range is outside all the spans, which are in order."""
    covered: list[list[int]] = []
    for start, _, end in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    if not covered:
        return np.ones(len(starts), bool)
    begins, stops = np.array(covered).T
    before = np.searchsorted(begins, ends - 1, side="right") - 1
    return (before < 0) | (stops[before] <= starts)


class _Places:
    """The words of a chunk, with their places in code points of their row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets, ALPHANUMERIC)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        base = np.repeat(points[offsets[:-1]], words.counts)
        self.starts = points[words.starts] - base
        self.ends = points[words.ends] - base

    def row(self, at: int) -> slice:
        return slice(int(self.words.bounds[at]), int(self.words.bounds[at + 1]))


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_ENTITY = pa.struct([("part", pa.int64()), ("entity", pa.string())])
_WORD = pa.struct([("part", pa.int64()), ("word", pa.int64())])
_PLACE = pa.struct([("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<start: long, rank: int, end: long>>"
_FOUND = (
    f"row string, kind string, spans {_SPANS}, entities array<struct<part: long, entity: string>>, "
    "words array<struct<part: long, word: long>>"
)


def _row() -> Column:
    """One document: its id and the digest of its text."""
    text = F.md5(F.coalesce("text", F.lit("")))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)


def _found(documents: DataFrame, part: int, min_chars: int) -> DataFrame:
    """row, kind (its text), spans, and of documents that hold an entity the entities with the parts
    they reach and the words of each part."""

    def find(batches):
        for batch, data, offsets in chunks(batches, "text"):
            places = _Places(data, offsets)
            spans, entities, words = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                own = pattern_spans(text) if text else []
                spans.append([dict(zip(("start", "rank", "end"), span)) for span in own])
                entities.append([])
                words.append([])
                if not own:
                    continue
                of_row = places.row(at)
                starts, ends = places.starts[of_row], places.ends[of_row]
                parts = np.arange(len(starts)) // part
                last = int(parts[-1]) if len(parts) else 0
                reached = set()
                for start, kind, end in own:
                    home = min(last, int(np.searchsorted(starts, start)) // part)
                    entity = _entity(text, start, kind, end)
                    near = range(max(0, home - 1), min(last, home + 1) + 1)
                    reached |= {(beside, entity) for beside in near}
                entities[-1] = [dict(zip(("part", "entity"), pair)) for pair in reached]
                terms = (ends - starts >= min_chars) & _free(starts, ends, own)
                hashes = places.words.hashes[of_row].view(np.int64)[terms]
                pairs = set(zip(parts[terms].tolist(), hashes.tolist()))
                words[-1] = [dict(zip(("part", "word"), pair)) for pair in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(spans, pa.list_(_SPAN)),
                    pa.array(entities, pa.list_(_ENTITY)),
                    pa.array(words, pa.list_(_WORD)),
                ],
                names=["row", "kind", "spans", "entities", "words"],
            )

    docs = documents.select(_row().alias("row"), F.md5("text").alias("kind"), "text")
    return docs.mapInArrow(find, _FOUND)


def _document_counts(documents: DataFrame) -> DataFrame:
    """(word, n): the number of documents that hold each word, known by its hash. A task sums up
    what it has counted whenever `limit` words have gathered."""
    limit = 1 << 22

    def count(batches):
        gathered, waiting = [], 0

        def total():
            seen = np.concatenate([seen for seen, _ in gathered])
            order = np.argsort(seen, kind="stable")
            seen = seen[order]
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            times = np.add.reduceat(np.concatenate([times for _, times in gathered])[order], first)
            return seen[first], times

        def batch_of(counted):
            seen, times = counted
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.view(np.int64)), pa.array(times, pa.int64())], names=["word", "n"]
            )

        for _, data, offsets in chunks(batches, "text"):
            words = Words(data, offsets, ALPHANUMERIC)
            if not len(words.hashes):
                continue
            rows = words.rows()
            order = np.lexsort((rows, words.hashes))
            hashes, rows = words.hashes[order], rows[order]
            new = np.ones(len(rows), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            gathered.append((hashes[new], np.ones(int(new.sum()), np.int64)))
            waiting += int(new.sum())
            if waiting > limit:
                gathered = [total()]
                waiting = len(gathered[0][0])
                if waiting > limit // 2:
                    yield batch_of(gathered[0])
                    gathered, waiting = [], 0
        if gathered:
            yield batch_of(total())

    counted = documents.select("text").mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n_term"))


def disclosures(
    found: DataFrame, documents: DataFrame, support: int = SUPPORT, least: float = GENERALISED
) -> DataFrame:
    """entity, word (the hash of a term) and the share of the entity's information that the term
    reveals, for the pairs in enough different texts whose share is `least` or more."""
    total = documents.count()
    kinds = found.where(F.size("entities") > 0).groupBy("kind").agg(
        F.count("*").alias("copies"),
        F.any_value("entities").alias("entities"),
        F.any_value("words").alias("words"),
    )
    kinds = written(kinds, "kinds")
    held = kinds.select("kind", "copies", F.explode("entities").alias("e"))
    held = held.select("kind", "copies", "e.part", "e.entity")
    names = F.array_distinct(F.transform("entities", lambda e: e["entity"]))
    entities = kinds.select("copies", F.explode(names).alias("entity")).groupBy("entity")
    entities = entities.agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"))
    entities = entities.where(F.col("texts") >= support).drop("texts")
    most = F.pow("n_entity", F.lit(least)) * float(max(total, 1)) ** (1 - least)
    entities = written(entities.withColumn("most", most * (1 + 1e-9)), "entities")
    cap = entities.agg(F.max("most")).head()[0] or 0.0
    held = held.join(entities, "entity")

    counts = written(_document_counts(documents).where(F.col("n_term").between(support, cap)), "words")
    terms = kinds.join(held.select("kind").distinct(), "kind", "left_semi")
    terms = terms.select("kind", F.explode("words").alias("w")).select("kind", "w.part", "w.word")
    # A document has so many words: not many can be in more than one of HOT documents.
    hot = F.broadcast(counts.where(F.col("n_term") * HOT > total))
    usual = terms.join(hot, "word", "left_anti").join(
        counts.where(F.col("n_term") * HOT <= total), "word"
    )
    terms = terms.join(hot, "word").unionByName(usual)
    pairs = terms.join(held, ["kind", "part"]).where("n_term <= most")
    pairs = pairs.dropDuplicates(["kind", "entity", "word"])
    pairs = pairs.groupBy("entity", "word", "n_entity", "n_term").agg(
        F.sum("copies").alias("n"), F.count("*").alias("texts")
    )
    bits = -F.log2(F.col("n_entity") / total)
    revealed = F.log2(F.col("n") * total / (F.col("n_entity") * F.col("n_term")))
    pairs = pairs.where(F.col("texts") >= support).withColumn(
        "share", F.when(bits > 0, revealed / bits)
    )
    return pairs.where(F.col("share") >= least).select("entity", "word", "share")


def _occurrences(documents: DataFrame, terms: DataFrame, min_chars: int) -> DataFrame:
    """row, start, end and rank of the places of disclosing terms in all documents."""
    known = None
    if terms.count() <= MOST_SENT:
        words = terms.select("word").toArrow().column(0).to_numpy()
        known = sent(documents.sparkSession, np.sort(words))

    def find(batches):
        listed = received(known) if known else None
        for batch, data, offsets in chunks(batches, "text"):
            places = _Places(data, offsets)
            hashes = places.words.hashes.view(np.int64)
            chosen = places.ends - places.starts >= min_chars
            if listed is not None:
                chosen &= np.isin(hashes, listed)
            bounds = np.concatenate([[0], np.cumsum(chosen)])[places.words.bounds]
            found = pa.StructArray.from_arrays(
                [pa.array(values[chosen]) for values in (hashes, places.starts, places.ends)],
                fields=list(_PLACE),
            )
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "places"])

    docs = documents.select(_row().alias("row"), "text")
    schema = "row string, places array<struct<word: long, start: long, end: long>>"
    places = docs.mapInArrow(find, schema).select("row", F.explode("places").alias("p"))
    return places.select("row", "p.*").join(terms, "word").select("row", "start", "end", "rank")


def _outside(found: DataFrame) -> DataFrame:
    """The pattern spans as `base`, and with them the terms that stand outside, in order."""

    def join(batches):
        for batch in batches:
            lists = []
            for base, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if terms:
                    spans = [(s["start"], s["rank"], s["end"]) for s in base]
                    starts, ends = (np.array([t[n] for t in terms]) for n in ("start", "end"))
                    free = _free(starts, ends, spans)
                    base = base + [term for term, alone in zip(terms, free) if alone]
                    base.sort(key=lambda s: (s["start"], s["rank"], s["end"]))
                lists.append(base)
            columns = [batch.column(0), batch.column(1), pa.array(lists, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "base", "spans"])

    found = found.select("row", F.col("spans").alias("base"), "terms")
    return found.mapInArrow(join, f"row string, base {_SPANS}, spans {_SPANS}")


def spans(
    documents: DataFrame,
    part: int = PART,
    min_chars: int = MIN_CHARS,
    support: int = SUPPORT,
    removed: float = REMOVED,
    generalised: float = GENERALISED,
) -> DataFrame:
    """row (doc_id and a digest of the text) and its spans (start, rank in KINDS, end), by start and
    rank; patterns in `base`, everything in `spans`."""
    docs = documents.select("doc_id", "text")
    found = written(_found(docs, part, min_chars), "found")
    shares = disclosures(found, docs, support, generalised).groupBy("word").agg(F.max("share").alias("s"))
    rank = F.when(F.col("s") >= removed, 4).otherwise(5)
    terms = written(shares.select("word", rank.alias("rank")), "terms")
    near = _occurrences(docs, terms, min_chars)
    near = near.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("terms"))
    return _outside(found.select("row", "spans").dropDuplicates(["row"]).join(near, "row", "left"))


def _listed(column: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",", F.transform(column, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"]))
    )


def summary(documents: DataFrame, **options) -> DataFrame:
    """A row per document: matches of each kind, the digest of the pattern spans, all spans."""
    docs = documents.select("doc_id", "text")
    found = spans(docs, **options)
    rows = docs.select("doc_id", _row().alias("row"))
    counts = [
        F.size(F.filter("base", _of(rank))).cast("long").alias(f"n_{kind}")
        for rank, kind in enumerate(KINDS[:4])
    ]
    return rows.join(found, "row").select(
        "doc_id",
        *counts,
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


def _of(rank: int):
    return lambda span: span["rank"] == rank


def _replacement(kind: int, word: str) -> str:
    if kind == 4:
        return ""
    if kind == 5:
        return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
    return f"[{KINDS[kind].upper()}]"


def replaced(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with its (start, kind, end) spans replaced; overlapping ones as the first."""
    parts, at = [], 0
    for start, kind, end in found:
        if start >= at:
            parts += [text[at:start], _replacement(kind, text[start:end])]
        at = max(at, end)
    return "".join(parts) + text[at:]


def sanitised(documents: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns, without the data found."""
    found = spans(documents, **options).select("row", "spans")
    given = documents.select(F.struct(*map(quoted, documents.columns)).alias("given"), _row().alias("row"))
    both = given.join(found, "row").select("given", F.col("given.text").alias("text"), "spans")

    def replace(batches):
        for batch in batches:
            texts = [
                text and replaced(text, [(s["start"], s["rank"], s["end"]) for s in own])
                for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            columns = [batch.column(0), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "text"])

    schema = both.select("given", "text").schema
    clean = both.mapInArrow(replace, schema)
    return clean.select(
        *[
            F.col("text") if name == "text" else F.col("given")[name].alias(name)
            for name in documents.columns
        ]
    )
