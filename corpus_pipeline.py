"""The corpus pipeline: documents through five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import minhash, mixing, packing, quality, secrets
from tabloom.llm.base import stored
from tabloom.session import load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive fences."""
    return quality.kept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefix of every leaf that the target weights ask for."""
    return mixing.sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Hash signatures, entropy windows and packing are outside SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs
