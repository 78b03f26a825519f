"""A training corpus from ``documents``: identify, dedup, mix and pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result
is written as Parquet and read again. All but the last return the columns of ``documents``.
A row that the mixture repeats comes out as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from skyloom.plans.staging import drop_staged, stage, staged_mark


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language profile, go: null, empty and odd texts among them. Repeated rows each stay or go alike."""
    return language_id.keep_identified(docs)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest, then the smallest id stays; one row of several that are alike in both. Null counts as empty."""
    return exact_dedup.keep_distinct(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the smallest id stays, null last. Texts without a word are classes of their own; rows that repeat an id are rows of their own."""
    return near_dedup.keep_one_of_each(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, a null one among them, are repeated or thinned to their targets. Empty texts count nothing; an empty table stays empty."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens are placed in sequences; a null text is just its end mark, and a repeated row is packed as often."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_identification),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]

#: Tokenizers and alignments can't be written as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``.

    Null, empty and very long texts, repeated rows and empty tables go through as the stages' operators define; further columns
    of ``documents``, whatever their names, come through all stages but the last. Once a stage is written, what it and
    its predecessor had staged is deleted.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_mark(spark)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
        drop_staged(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
