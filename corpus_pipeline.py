"""A corpus pipeline from the operators of ``ledgerloom.llm``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, pii, quality, simhash
from ledgerloom.llm.common import read, stage

#: SQL cannot express the trained stages; tests/llm holds each stage against a brute-force version instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated classifier go.

    Null, empty and short texts go; repeated rows stay or go alike; long texts are judged whole; other columns are carried along, whatever
    their names; an empty table gives no rows, and without usable labels only the base rules decide.
    """
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Texts without words are one group; of rows that share the smallest id one stays; other columns are carried along;
    an empty table gives no rows.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go.

    Null and empty texts stay; repeated rows stay or go alike; other columns are carried along, whatever their names; an empty table
    gives no rows, an empty benchmark removes none.
    """
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets.

    Null texts stay null; no row goes; repeated rows are treated alike; other columns are carried along, whatever their names; an
    empty table gives no rows.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each copy taken, numbered in mix_copy.

    A null source is a source of its own, the last; texts without words have size 0; repeated rows are taken alike; in a table that has
    a column mix_copy the new one gets underscores; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", redact_pii),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
