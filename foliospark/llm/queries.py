"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_crf, jaccard_join, license_scan, lm_score, packing, quality_rules, repeats, token_codec, tool_chat
from .common import documents, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.digest(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "text_key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op10_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.link(*tool_chat.turns_as_calls(table(spark, sf_dir, "conversations")), tool_chat.ANSWER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_suffix_dedup, op3_html_extraction, op4_token_codec, op5_jaccard_join, op6_quality_rules, op7_packing, op8_decontamination, op9_license_scan, op10_tool_chat)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard_join.sql(), "op6_quality_rules": quality_rules.sql(), "op8_decontamination": decontam.sql(), "op9_license_scan": license_scan.sql()}
