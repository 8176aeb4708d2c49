"""A corpus made ready for training: filtered, deduplicated, cleaned, mixed and packed.

Each stage takes what its predecessor has kept. All but the last return the columns of ``documents``.

Edge cases are those of the operators: rows with null texts are scored, and kept if the classifier keeps them; rows with
null doc_ids go through all stages; extra columns of ``documents`` are carried along up to the last stage; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import jaccard, mixing, packing, quality, secrets
from tallywright.llm.scratch import drop, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest doc_id."""
    return jaccard.first_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources have their target weights."""
    return mixing.mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_documents),
]

#: The classifier and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
