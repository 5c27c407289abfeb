"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm import common, decontaminate, line_dedup, mixing, near_dedup, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The trees learn from the labelled documents of sf_dir."""
    forest = quality_rules.train(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, forest)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one of the smallest doc_id."""
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: fingerprints within three bits, or 0.8 of the five-word shingles in common."""
    return near_dedup.apply(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontaminate.apply(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with n_copies."""
    return mixing.apply(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mix)]

#: Boosted trees have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
