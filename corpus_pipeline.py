"""A training-data pipeline over ``documents``: language ID, exact deduplication, near-duplicate join, mixing, packing.

Each stage works on all that the one before kept, and its result is written as Parquet and read again. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences. An empty table gives an empty one at each stage; columns of any other names are
carried along unread; null ids are ids like others. What a stage does with nulls, ties and repeated rows is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import exact_dedup, langid, mixing, near_join, packing
from tidelane.llm.common import deleted, saved, scratch, small_batches, table

#: By application: what the stage before left in the shared folder. Its result is written before the next stage is called.
_left: dict[str, list[str]] = {}


def _staged(spark: SparkSession, make: Callable[[DataFrame], DataFrame], docs: DataFrame, first: bool = False) -> DataFrame:
    """A stage's result; the files that the stage before worked with are deleted first. The first stage leaves those of another run, whose result may not have
    been read yet."""
    small_batches(spark)
    application = spark.sparkContext.applicationId
    before = _left.pop(application, [])
    deleted(spark, [] if first else before)
    with scratch() as paths:
        out = make(docs)
    _left[application] = paths
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the languages given, rejects go: null texts, those without a letter, those of no clear language.

    Documents without a language are judged like others, though nothing is learned from them; empty texts go; repeated rows stay or go together.
    """
    return _staged(spark, langid.accepted, docs, first=True)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without white space the longest stays, then the smallest id (null last), then one row. A null text counts as empty."""
    return _staged(spark, exact_dedup.deduplicated, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays, that of the smallest id (null first), then one row. Texts without words are one class."""
    return _staged(spark, near_join.one_of_each, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, each as often as it is taken (up to three times, or not at all).

    Documents without words are never taken; a null source is a source, the last; ties go by id, then size, then row.
    """
    return _staged(spark, mixing.mixed, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 1024 tokens. Each copy of a repeated document is packed on its own."""
    return _staged(spark, packing.packed, docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_join", near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: The language classifier can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
