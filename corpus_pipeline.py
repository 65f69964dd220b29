"""A training corpus from raw documents: rules, a classifier, near-duplicates, a source mix, and piece ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; its result is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import mixing, near_copies, quality_classifier, quality_rules, spm_codec
from vacantia.llm.scratch import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labels of rows that aren't held out, predicts as good."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity from 0.8), the one with the smallest id."""
    return near_copies.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of their domain, language and source: 95 % of all tokens, no document twice."""
    return mixing.mixed_documents(docs, share=0.95, epochs=1)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the piece ids of its text; decodes and parity say whether both libraries agree on it."""
    import public_tokenizers

    return spm_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("mixture", mixture), ("piece_ids", piece_ids)]

#: The stages have no form in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
