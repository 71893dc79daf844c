"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark windows
go, secrets are masked, and what is left is packed into sequences.

Each stage reads null texts as empty.  An empty table gives an empty result.  Extra columns are kept
up to packing.  Rows that repeat a ``doc_id`` stay or go by their own texts in the near-duplicate
stage; rows without a ``doc_id`` stay there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import decontaminate, jaccard_join, packing, queries, secret_scan, toxicity
from factorloom.workspace import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, model) < queries.TOXIC_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    return jaccard_join.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.remove(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Learnt scores and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
