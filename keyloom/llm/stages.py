"""The corpus pipeline: language ID, exact dedup, near duplicates, benchmark decontamination, mixing.

A stage gets the rows that its predecessor kept and decides about all of them; each is written as Parquet and read again. All
columns are kept from stage to stage; the last stage gives the mixed corpus: every row as often as the mix takes it, which for
some is not at all.

Defined cases: documents with null, empty or blank text hold no letter and go at the first stage; null or repeated ids are rows
like any other, of equal texts one row stays; an empty table gives an empty one at each stage; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, dedup, jaccard, langid, mixing
from keyloom.llm.common import table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language classifier rejects."""
    return langid.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.deduplicated(docs)


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.near_deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct_texts),
    ("near_duplicates", distinct_sets),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
]

#: Compression classification and entropy balancing aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
