"""Whole texts as byte arrays: chunks of Arrow batches, words, and 64-bit hashes of byte runs.

Tasks see the UTF-8 bytes of a text column as one array with row offsets. Every step works on
whole arrays, so the cost per byte is a few numpy passes. A chunk holds at most `CHUNK_BYTES`
of text, or one row if that row alone is longer: memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableview.catalog import quoted

CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the splitmix64 finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _power(kind: str, length: int) -> np.ndarray:
    if len(_powers[kind]) < length:
        step = _BASE if kind == "base" else _BASE_INVERSE
        factors = np.full(1 << (length - 1).bit_length() if length > 1 else 1, step, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind][:length]


class Hashes:
    """Hashes of any runs [start, end) of the bytes: equal bytes, equal hash, wherever they are."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power("base", len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _power("inverse", len(self.sums))[starts])


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every `length` consecutive words, by first word."""
    count = max(0, len(hashes) - length + 1)
    total = np.zeros(count, np.uint64)
    factor = 1
    for place in range(length):
        total += hashes[place : place + count] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return mixed(total)


def ordered(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each run of hashes between bounds, in their order; 0 for an empty run."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes) * _power("base", len(hashes)), out=sums[1:])
    total = (sums[bounds[1:]] - sums[bounds[:-1]]) * _power("inverse", len(sums))[bounds[:-1]]
    return mixed(total)


class Words:
    """The words of a chunk: byte range, hash, and the bounds of each row's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.data = LOWER[data]
        inside = letters[self.data]
        size = len(inside)
        edges = offsets[(offsets > 0) & (offsets < size)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] |= inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] |= inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.hashes = Hashes(self.data).of(self.starts, self.ends)

    def text(self, begin: int, end: int) -> bytes:
        """Words [begin, end), joined by one blank."""
        return b" ".join(
            self.data[self.starts[at] : self.ends[at]].tobytes() for at in range(begin, end)
        )

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def within(self, length: int) -> np.ndarray:
        """First words of the runs of `length` words that stay inside their row."""
        rows = self.rows()
        if len(rows) < length:
            return np.zeros(0, np.int64)
        return np.flatnonzero(rows[: len(rows) - length + 1] == rows[length - 1 :])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its row offsets; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    offsets = offsets.astype(np.int64)
    if values is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for batch in batches:
        place = batch.schema.names.index(column)
        if batch.num_rows == 0:
            continue
        data, offsets = bytes_of(batch.column(place))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            low, high = offsets[begin], offsets[end]
            yield batch.slice(begin, end - begin), data[low:high], offsets[begin : end + 1] - low
            begin = end


def annotate(
    frame: DataFrame,
    column: str,
    fields: list[T.StructField],
    prepare: Callable[[], Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The frame with one more column per field, computed from the bytes of a text column.

    `prepare` runs once per task and returns the function for a chunk. `keep` names the input
    columns of the result (default: all).
    """
    keep = frame.columns if keep is None else keep
    kept = frame.select(*map(quoted, keep))
    # Under names of their own: `mapInArrow` takes none with a dot.
    given = [quoted(name).alias(f"given_{at}") for at, name in enumerate(keep)]
    given = frame.select(*given, quoted(column).alias("text"))
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        compute = prepare()
        for batch, data, offsets in chunks(batches, "text"):
            columns = [batch.column(place) for place in range(len(keep))]
            columns += compute(batch.rename_columns([*keep, "__text"]), data, offsets)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of the frame is called so."""
    taken = {name.lower() for name in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found
