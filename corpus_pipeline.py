"""The training-data pipeline: stages that each call one operator on all that the one before kept.

The quality classifier rejects documents; line dedup deletes later copies of repeated line runs, and
documents that held nothing else; of each group of near copies one document stays; mixing repeats or
drops documents by rates that bring the languages to their target shares; packing fills windows. Each
stage's result is written as Parquet and read again, so a lost executor never costs an earlier stage.

Every stage works on all rows that the one before kept, and returns the columns of documents, the last one pieces.

Defined cases, beside those of the operators: without labels of both classes nothing is known of quality and the
first stage keeps all; a document without text (or with blank lines alone) passes line dedup as it is; rows that repeat, with the
same doc_id and text, are copies in near dedup like any others, so one of them stays, and documents without words, linked with
nothing, all stay; without labels of a language mixing keeps all rates at one; empty tables give empty tables; null ids, languages and
sources are kept as they are; further columns of documents pass through the stages before packing.

SQL expresses neither the classifier nor what follows it, so there is none; the tests compare each stage with its
operator and the operators with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidflow.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from braidflow.llm.common import Scratch, table

#: The least similarity of near copies; op2_near_dedup's own is 85.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go; without labels of both classes none does."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that held nothing else; n_chars follows the text."""
    return line_dedup.keep_rest(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; the labelled documents' languages are the domains."""
    return mixing.repeat(docs, mixing.language_labels(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
