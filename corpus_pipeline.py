"""The training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Rejected documents go, of each group of near-duplicates the one with the smallest id stays, passages of ``benchmark``
and secrets are taken out of the texts, and what is left is encoded.

Defined results: a null or empty text is left alone by every stage but the first, which judges it like any other, and
encodes to no ids; rows without doc_id go through all stages, and near copies among them leave one; of repeated rows of
one doc_id one stays; ties go to the smallest doc_id; an empty table gives an empty result with the same columns;
extra columns, of any name, are kept up to the encoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import cotraining, decontaminate, near_duplicates, secrets, unigram
from draftlake.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.encode_checked(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the encoding can't be expressed in SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
