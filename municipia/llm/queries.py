"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from municipia.llm import (
    chat_perspectives,
    decontamination,
    filter_audit,
    jaccard_join,
    language_id,
    license_scan,
    lm_scoring,
    oracles,
    packing,
    quality_ranking,
    quality_rules,
    sentencepiece_codec,
    structure_repair,
    token_files,
)
from municipia.llm.shared import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that the labels call good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm_scoring.loss_difference(table(spark, sf_dir, "documents"), good)


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.file_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, BYTE_MODEL)
    return token_files.read_token_files(spark, path, digest=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_MODEL)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_ranking": op3_quality_ranking,
    "op4_language_id": op4_language_id,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_structure_repair": op12_structure_repair,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": oracles.JACCARD_JOIN,
    "op5_chat_perspectives": chat_perspectives.ORACLE,
    "op6_license_scan": oracles.license_scan(license_scan.TEMPLATES),
    "op9_decontamination": oracles.DECONTAMINATION,
    "op12_structure_repair": structure_repair.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
