"""Heavy hitters: exact counts, summary tables, approximate top-k, windows of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(events: DataFrame, key: str = "key") -> DataFrame:
    return events.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"))


def top(counted: DataFrame, k: int) -> DataFrame:
    """The k largest (key, cnt), ties by key: a bounded sort in every task, then one of k rows each."""
    return counted.orderBy(F.desc("cnt"), F.asc("key")).limit(k)


def ranked(topk: DataFrame) -> DataFrame:
    """topk (k rows) with ranks from 1."""
    return topk.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("key"))))


def rollup(events: DataFrame, *buckets: str) -> DataFrame:
    """(buckets, key, cnt): combined in each task before the shuffle."""
    return events.groupBy(*buckets, "key").agg(F.count("*").alias("cnt"))


def rollup_merged(*rollups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Additive upsert of summary tables."""
    whole = rollups[0]
    for r in rollups[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy(*by).agg(F.sum("cnt").cast("long").alias("cnt"))


def approximate(events: DataFrame, k: int, counters: int = 10_000) -> DataFrame:
    """(key, cnt) from the built-in frequent-items sketch, whose state has a fixed size."""
    return events.agg(F.expr(f"approx_top_k(key, {k}, {counters})").alias("t")).select(F.inline("t")).select(F.col("item").alias("key"), F.col("count").cast("long").alias("cnt"))


def bucket_candidates(bucketed: DataFrame, bucket: str, n: int) -> DataFrame:
    """Distinct keys that are among the first n of any bucket; bucketed has (bucket, key, cnt)."""
    first = Window.partitionBy(bucket).orderBy(F.desc("cnt"), F.asc("key"))
    return bucketed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= n).select("key").distinct()


def windowed(bucketed: DataFrame, bucket: str, n: int, k: int) -> DataFrame:
    """Top k of the candidates by their counts over all buckets."""
    whole = rollup_merged(bucketed, by=("key",))
    return top(whole.join(bucket_candidates(bucketed, bucket, n), "key", "left_semi"), k)


def summed_tops(bucketed: DataFrame, bucket: str, n: int, k: int) -> DataFrame:
    """The mistake that windowed() avoids: only what made a bucket's first n is summed."""
    first = Window.partitionBy(bucket).orderBy(F.desc("cnt"), F.asc("key"))
    kept = bucketed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= n)
    return top(rollup_merged(kept.drop("r"), by=("key",)), k)
