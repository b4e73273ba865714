"""A training corpus in five stages: language ID, exact dedup, near dedup, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next
stage's ``docs``. The first four return the columns of ``documents``, the last returns the packed pieces. Columns of
other names stay as they are, whatever they are called, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from learnloom.llm import exact_dedup, language_id, mixing, packing, simhash
from learnloom.llm.common import replaced, scope, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every language that the labelled rows teach.

    A null or empty text has no letter. Repeated rows are decided alike. Without labelled rows nothing is kept.
    """
    return language_id.drop_unknown_languages(docs, language_id.fit(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each text. A null text is the empty one, a null id the largest.

    Of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: SimHash finds them, a Jaccard similarity of 0.8 of five-word shingles links them.

    That with the smallest id stays, each of its rows if it is repeated. Texts without words are one group.
    """
    return simhash.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until each source has its share, in training order. A null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; repeated rows are packed each, a null text as its end id alone."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix),
    ("packing", pack),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage wrote for itself is removed with its end, and its input with the next one's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark):
            docs = replaced(docs, stored(stage(spark, docs, sf_dir), scoped=False))
    return STAGES[-1][1](spark, docs, sf_dir)
