"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import decontaminate, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, secret_scan, suffix_dedup, token_counts, url_rules


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.report(C.documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(C.documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return quality_rules.verdicts(docs, quality_rules.train(docs, C.table(spark, sf_dir, "labels")))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(C.table(spark, sf_dir, "pages"), C.table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(C.documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(C.documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(C.documents(spark, sf_dir), *token_counts.read_vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(C.documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(C.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scoring, op2_line_dedup, op3_quality_rules, op4_url_rules, op5_simhash, op6_secret_scan, op7_token_counts, op8_decontamination, op9_mixing, op10_suffix_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op6_secret_scan": secret_scan.oracle_sql(), "op8_decontamination": decontaminate.ORACLE_SQL, "op9_mixing": mixing.oracle_sql()}
