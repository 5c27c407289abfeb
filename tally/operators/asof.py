"""As-of audits: what a reader was served against what had been written by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import indexed

# Fixed value: how far a write may be stamped after a read that it may have served.
SLOP_MS = 100


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], shift_ms: int = 0) -> DataFrame:
    """left with each value of the last right row of its key at or before `at` + shift_ms.

    One sort by key and time over both sides; no range join.
    """
    names = left.columns
    marked = left.withColumn("_t", F.col(at) + shift_ms).withColumn("_side", F.lit(1))
    facts = right.select(F.col(by), F.col(at).alias("_t"), F.struct(*values).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(facts, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*names, *[F.col("_last")[v].alias(f"as_of_{v}") for v in values])


def stale_reads(reads: DataFrame, writes: DataFrame, slop_ms: int = SLOP_MS) -> DataFrame:
    """reads (strategy, id, ts, price, source) with judged, stale and staleness_ms, against writes (strategy, id, ts, price).

    A read is judged if a write is at or before its time plus the slop, and stale if it was
    served another price. Its staleness runs from the write after the one it was served, or
    from the first if it was served none of them.
    """
    key = F.concat_ws("/", "strategy", F.col("id").cast("string"))
    history = writes.withColumn("k", key)
    order = Window.partitionBy("k").orderBy("ts", "price")
    history = history.withColumn("next_ts", F.lead("ts").over(order))
    firsts = history.groupBy("k").agg(F.min("ts").alias("first_ts"))
    judged = as_of(reads.withColumn("k", key), history, "k", "ts", ["price"], slop_ms)
    # The origin of a served price: the last write of that price at or before the read.
    served = judged.withColumn("kp", F.concat_ws("/", "k", F.col("price").cast("string")))
    origin = as_of(served, history.withColumn("kp", F.concat_ws("/", "k", F.col("price").cast("string"))), "kp", "ts", ["next_ts", "ts"])
    joined = origin.join(firsts, "k", "left")
    stale = F.col("as_of_price").isNotNull() & (F.col("as_of_price") != F.col("price"))
    since = F.when(F.col("as_of_ts").isNotNull(), F.coalesce("as_of_next_ts", F.col("ts"))).otherwise(F.col("first_ts"))
    return joined.select("strategy", "id", "ts", "price", "source", F.col("as_of_price").isNotNull().alias("judged"), stale.alias("stale"), F.when(stale, F.greatest(F.lit(0).cast("long"), F.col("ts") - since)).alias("staleness_ms"))


def summary(audited: DataFrame) -> DataFrame:
    """(strategy, reads, judged, hit_rate, stale_count, stale_pct, p50_ms, p99_ms, max_ms)."""
    flag = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    base = audited.groupBy("strategy").agg(F.count("*").alias("reads"), flag("judged").alias("judged"), F.round(100 * F.sum(F.col("source").startswith("cache").cast("int")) / F.count("*"), 1).alias("hit_rate"), flag("stale").alias("stale_count"), F.coalesce(F.max("staleness_ms"), F.lit(0)).alias("max_ms"))
    pct = indexed(audited.filter("stale"), ["strategy"], "staleness_ms", [50.0, 99.0]).groupBy("strategy").agg(F.max(F.when(F.col("p") == 50.0, F.col("value"))).alias("p50_ms"), F.max(F.when(F.col("p") == 99.0, F.col("value"))).alias("p99_ms"))
    share = F.when(F.col("judged") > 0, F.round(100 * F.col("stale_count") / F.col("judged"), 2)).otherwise(F.lit(0.0))
    return base.join(pct, "strategy", "left").select("strategy", "reads", "judged", "hit_rate", "stale_count", share.alias("stale_pct"), F.coalesce("p50_ms", F.lit(0)).alias("p50_ms"), F.coalesce("p99_ms", F.lit(0)).alias("p99_ms"), "max_ms")


def buckets(audited: DataFrame, width_ms: int) -> DataFrame:
    """(strategy, bucket, reads, stale, max_ms): buckets of equal width from each strategy's first read."""
    starts = audited.groupBy("strategy").agg(F.min("ts").alias("t0"))
    placed = audited.join(starts, "strategy").withColumn("bucket", F.floor((F.col("ts") - F.col("t0")) / width_ms))
    return placed.groupBy("strategy", "bucket").agg(F.count("*").alias("reads"), F.sum(F.col("stale").cast("int")).cast("long").alias("stale"), F.coalesce(F.max("staleness_ms"), F.lit(0)).alias("max_ms"))
