"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of documents; the last one returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableview.llm import decontaminate, jaccard_join, language, line_dedup, packing
from tableview.llm.tables import read, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go."""
    return language.accepted(docs)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first one stays; documents left without a line go."""
    return line_dedup.deduplicated(docs)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return packing.packed(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedupe_lines),
    ("jaccard_join", dedupe_documents),
    ("decontaminate", without_benchmark),
    ("packing", pack),
]

#: A trained language model and SimHashes are beyond SQL; the tests compare run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
