"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import chat, decontam, html_extract, license_scan, line_dedup, mixing, pii, quality, sharding, simhash
from tickloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html_extraction, op2_pii, op3_kd_sharding, op4_quality_rules, op5_simhash_dedup, op6_line_dedup, op7_chat_formatting, op8_license_scan, op9_source_mixing, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.oracle(), "op6_line_dedup": line_dedup.ORACLE, "op7_chat_formatting": chat.ORACLE, "op9_source_mixing": mixing.ORACLE, "op10_decontamination": decontam.ORACLE}
