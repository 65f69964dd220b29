"""The operators of this package as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_table

    return mix_table(_table(spark, sf_dir, "documents"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import score

    return score(_table(spark, sf_dir, "documents"), _piece_model())


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_index import archived

    return archived(_table(spark, sf_dir, "pages"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    return judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _piece_model())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    return groups(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm_codec import encode

    return encode(_table(spark, sf_dir, "documents"), _piece_model())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_matroska, op3_simhash, op4_mixing, op5_attention_lm, op6_warc_index, op7_url_rules, op8_token_counts, op9_quality_classifier, op10_sentencepiece, op11_spelling, op12_suffix_dedup, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from . import mixing, quality_rules, spelling, suffix_dedup, warc_index

    return {"op1_quality_rules": quality_rules.ORACLE, "op4_mixing": mixing.ORACLE, "op6_warc_index": warc_index.ORACLE, "op11_spelling": spelling.ORACLE, "op12_suffix_dedup": suffix_dedup.ORACLE}
