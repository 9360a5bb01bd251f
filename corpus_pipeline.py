"""The corpus pipeline: quality, language, near-duplicates, mixing, packing.

Each stage works on all documents its predecessor kept, and handles nulls, empty texts and tables, repeated
rows and extra columns as its operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netprobe.functions.tables import discard, made, materialize
from netprobe.llm import langid, mixing, neardup, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality.filter_quality(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised."""
    return langid.filter_language(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them: some twice, some in part, some not."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("minhash_neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language identification and MinHash bands have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written out and read again. A stage's own tables, and its predecessor's
    result, are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = made()
    for name, stage in STAGES[:-1]:
        kept = made()
        out = stage(spark, docs, sf_dir)
        docs = materialize(out, f"pipeline-{name}")
        discard(spark, begin, kept)  # the predecessor's result
        begin = made() - 1
        discard(spark, kept, begin)
    return STAGES[-1][1](spark, docs, sf_dir)
