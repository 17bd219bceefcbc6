"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableview.llm import (
    archives,
    decontaminate,
    divergence,
    jaccard_join,
    language,
    licenses,
    line_dedup,
    neighbours,
    packing,
    pii,
    prefix_trie,
    suffixes,
    toxicity,
)
from tableview.llm.sql import SQL
from tableview.llm.tables import read

__all__ = ["QUERIES", "SQL"]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.summary(read(spark, folder, "documents"))


def op2_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(read(spark, folder, "pages"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.grouped(read(spark, folder, "documents"))


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read(spark, folder, "embeddings"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(read(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"))


def op7_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.summary(read(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.summary(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.summary(read(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.summary(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.grafted_trie(read(spark, folder, "conversations"))


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summary(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_archives": op2_archives,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_neighbours": op4_neighbours,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
    "op11_divergence": op11_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_licenses": op13_licenses,
}
