"""The corpus pipeline: documents to training text, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs are all rows that its predecessor kept, and returns a DataFrame: all
but the last with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veinstone.llm import bpe, mixing, quality, secrets, simhash
from veinstone.llm.common import fresh_path, intermediates_removed, remove, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that their sources meet their target weights."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded bytes."""
    return bpe.digest_documents(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenise),
]

#: Components of similar texts, a fitted error rate over the corpus, and byte-pair merges are beyond SQL: tests/llm/test_pipeline.py
#: holds each stage, on what its predecessor kept, against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage writes on its way goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"pipeline-{k}")
        with intermediates_removed(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(found.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
