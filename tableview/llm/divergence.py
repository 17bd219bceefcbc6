"""Source divergence audit: how far the sources of a language are from each other in their terms.

Terms are runs of A-Z (as a-z), a-z and characters beyond ASCII. One `bytes.translate` lowers the
letters and blanks everything that separates terms, `bytes.split` cuts the terms, and a `Counter`
per document gives their counts. Tasks add the documents of a group (language, source) up, for at
most `HELD` terms at a time, before anything is shuffled; the sums are sparse, a row for each term
that a group has.

A language keeps the terms that at least `min_docs` of its documents hold. A group, and a language,
gives each kept term the share p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)),
N being its count over all V kept terms. All of that is whole numbers.

* `pair`: the sum of abs(p - q) over all kept terms, for each two sources of a language. Sources
  are dealt into blocks of about `BLOCK` and terms into buckets of about `BUCKET`; a task takes one
  bucket of two blocks, and the parts of a pair are added up. A term that a source lacks has the
  share of count 0, so only the sparse rows and a row per source are sent. Work grows with the
  pairs of blocks, as the result does with the pairs of sources.
* `term`: the `top` terms of which a group has more than its language, by p - q.

Null text, lang and source are empty. Every group that occurs takes part, also without terms; a
language that keeps no term has pairs of value 0 and no terms. Ties go to the item that is smaller
in UTF-8. Repeated rows count as often as they are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableview.llm.tables import written
from tableview.llm.texts import chunks

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50

#: Terms of a task that are added up before they go on.
HELD = 200_000
#: About so many sources and terms meet in one task.
BLOCK = 256
BUCKET = 4_096

#: Letters as lower-case ones, everything beyond ASCII as it is, the rest blank.
TABLE = bytes(
    at + 32 if 65 <= at <= 90 else at if 97 <= at <= 122 or at >= 128 else 32 for at in range(256)
)

COUNTED = "lang string, source string, term string, docs long, n long"


def term_counts(text: bytes) -> Counter:
    return Counter(text.translate(TABLE).split())


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents and occurrences of each term of a group. Every
    group has a row without a term, too, with its number of documents."""
    given = documents.select(
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source", "text")]
    )

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch, data, offsets in chunks(batches, "text"):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, key in enumerate(zip(langs, sources)):
                docs, places = groups[key]
                before = len(docs)
                found = term_counts(data[offsets[row] : offsets[row + 1]].tobytes())
                docs.update(found.keys())
                docs[None] += 1
                places.update(found)
                held += len(docs) - before
                if held >= HELD:
                    yield _rows(groups)
                    groups.clear()
                    held = 0
        yield _rows(groups)

    parts = given.mapInArrow(run, COUNTED)
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n")
    )


def _rows(groups: dict) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], []]
    for (lang, source), (docs, places) in groups.items():
        columns[0] += [lang] * len(docs)
        columns[1] += [source] * len(docs)
        columns[2] += [None if term is None else term.decode() for term in docs]
        columns[3] += docs.values()
        columns[4] += [places[term] for term in docs]
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    names = ["lang", "source", "term", "docs", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _share(count: str, total: str, kept: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * kept)), in whole decimals."""
    return F.expr(
        f"1L + (cast({scale} AS decimal(18,0)) * cast({count} + {smoothing} AS decimal(20,0)))"
        f" div cast({total} + {smoothing} * {kept} AS decimal(38,0))"
    )


def shares(
    documents: DataFrame,
    min_docs: int = MIN_DOCS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    block: int = BLOCK,
    bucket: int = BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, zero, v) and the terms that they have (lang, source, term, p, q),
    all with the numbers of `blocks` and `buckets` of the language.

    v is the number of kept terms, zero the share of a term that the group lacks (0 where nothing
    is kept), p a term's share in the group and q in the language.
    """
    counts = written(counted(documents), "terms")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term")
    kept = kept.agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"))
    kept = written(kept.where(F.col("docs") >= min_docs).select("lang", "term", "all"), "kept")
    cells = counts.where("term IS NOT NULL").join(kept, ["lang", "term"])
    cells = written(cells.select("lang", "source", "term", "n", "all"), "cells")
    own = counts.where("term IS NULL").select("lang", "source")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    langs = own.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    langs = langs.select(
        "lang",
        "v",
        "total",
        F.ceil(F.col("sources") / block).alias("blocks"),
        F.ceil(F.greatest("v", F.lit(1)) / bucket).alias("buckets"),
    )
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    zero = _share("0L", "coalesce(sum, 0)", "v", smoothing, scale)
    groups = own.join(langs, "lang").join(sums, ["lang", "source"], "left")
    groups = written(groups.withColumn("zero", F.coalesce(zero, F.lit(0))), "groups")
    shown = cells.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share("n", "sum", "v", smoothing, scale).alias("p"),
        _share("all", "total", "v", smoothing, scale).alias("q"),
        "blocks",
        "buckets",
    )
    v = F.coalesce("v", F.lit(0)).alias("v")
    groups = groups.select("lang", "source", "zero", v, "blocks", "buckets")
    return groups, written(shown, "shares")


def _distances(key: tuple, table: pa.Table) -> pa.Table:
    """The part of sum(abs(p - q)) of one bucket of terms, for the sources of block `a` with those
    of block `b`. Terms that none of them has differ by the shares of count 0: those are added for
    all terms in the first bucket, and taken off again for the terms that are met."""
    lang, bucket, a, b = (value.as_py() for value in key)
    whole = pc.is_null(table["term"])
    of_group, cells = table.filter(whole), table.filter(pc.invert(whole))
    sources = of_group["source"].combine_chunks()
    blocks, zero = of_group["block"].to_numpy(), of_group["p"].to_numpy()
    rows = pc.index_in(cells["source"], value_set=sources).to_numpy()
    terms = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    values = cells["p"].to_numpy()
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    left, right = np.flatnonzero(blocks == a), np.flatnonzero(blocks == b)
    total = np.zeros((len(left), len(right)), np.int64)
    count = int(terms[-1]) + 1 if len(terms) else 0
    rest = of_group["v"][0].as_py() * (bucket == 0) - count
    # So many terms at a time that the dense shares stay small, whatever the sources are.
    step = max(1, (1 << 22) // max(1, len(sources)))
    for begin in range(0, count, step):
        low, high = np.searchsorted(terms, [begin, begin + step])
        dense = np.repeat(zero[:, None], min(step, count - begin), axis=1)
        dense[rows[low:high], terms[low:high] - begin] = values[low:high]
        for at, source in enumerate(left):
            total[at] += np.abs(dense[right] - dense[source]).sum(axis=1)
    total += rest * np.abs(zero[left][:, None] - zero[right][None, :])
    one, other = np.repeat(left, len(right)), np.tile(right, len(left))
    apart = one != other if a == b else np.ones(len(one), bool)
    one, other, found = one[apart], other[apart], total.ravel()[apart]
    if a != b:
        one, other = np.concatenate([one, other]), np.concatenate([other, one])
        found = np.concatenate([found, found])
    return pa.table(
        {
            "lang": pa.array([lang] * len(one), pa.string()),
            "source": sources.take(pa.array(one)),
            "item": sources.take(pa.array(other)),
            "value": pa.array(found, pa.int64()),
        }
    )


def pairs(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    of_groups = groups.withColumn("bucket", numbers("buckets")).select(
        "lang",
        "bucket",
        "blocks",
        "source",
        F.lit(None).alias("term"),
        F.col("zero").alias("p"),
        "v",
    )
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")
    none = F.lit(0).cast("long").alias("v")
    of_terms = shown.select("lang", bucket, "blocks", "source", "term", "p", none)
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    # Each row goes to every pair of blocks that the block of its source belongs to.
    met = of_groups.union(of_terms).withColumns({"block": block, "other": numbers("blocks")})
    met = met.select(
        "lang",
        "bucket",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        "block",
        "source",
        "term",
        "p",
        "v",
    )
    parts = met.groupBy("lang", "bucket", "a", "b").applyInArrow(
        _distances, "lang string, source string, item string, value long"
    )
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    documents: DataFrame,
    min_docs: int = MIN_DOCS,
    smoothing: int = SMOOTHING,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of a group and its telling terms."""
    groups, shown = shares(documents, min_docs, smoothing, scale)

    def ranked(part: str, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        rank = F.row_number().over(order).alias("rank")
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)

    more = shown.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    terms = ranked("term", more.withColumnRenamed("term", "item")).where(F.col("rank") <= top)
    return ranked("pair", pairs(groups, shown)).union(terms)
