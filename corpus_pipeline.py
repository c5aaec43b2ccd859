"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes null and empty texts as texts without words, null and repeated doc_ids as rows of their own, further
columns under any name as they are, and an empty table to an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyline.llm import exact, near, packing, quality, secrets
from rallyline.session import remove, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, predicts to be good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts up to white space: the longest, then the smallest doc_id."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by word 5-gram Jaccard similarity of 0.8 or more: the smallest doc_id."""
    return near.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in text and n_chars brought up to date."""
    return secrets.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences instead of documents."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier, the decoding worklist and the tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again. A folder is
    removed once the next one is written; the last one stays, as the result is computed from it."""
    docs = table(spark, sf_dir, "documents")
    place, old = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{place}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if old:
                remove(spark, old)
            old = path
    return docs
