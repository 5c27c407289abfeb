"""Order-shaped checks and reports as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import text_hash


def monotonic_violations(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Rows whose value isn't above the one before it in its group."""
    w = Window.partitionBy(*by).orderBy(pos)
    return df.withColumn("before", F.lag(value).over(w)).filter(F.col(value) <= F.col("before"))


def repeats(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Every row of a key after its first sighting."""
    return df.withColumn("sighting", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("sighting > 1")


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest order of each key, by an aggregate: no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return best.select(*keys, *[F.col("_x")[c].alias(c) for c in rest])


def rank_displacement(df: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """(by, n, displacement): the sum of |arrival rank - sorted rank| over n squared."""
    arrival, ordered = (Window.partitionBy(by).orderBy(c) for c in (pos, value))
    ranks = df.select(by, F.row_number().over(arrival).alias("a"), F.row_number().over(ordered).alias("s"))
    return ranks.groupBy(by).agg(F.count("*").alias("n"), (F.sum(F.abs(F.col("a") - F.col("s"))) / (F.count("*") * F.count("*"))).alias("displacement"))


def gaps(df: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, n, top): groups whose row count differs from their greatest sequence number."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.max(seq).alias("top")).filter("n <> top")


def running_balance(entries: DataFrame, account: str, order: list[str], amount: str) -> DataFrame:
    """entries with seq from 1 and balance for each account."""
    w = Window.partitionBy(account).orderBy(*order)
    return entries.withColumn("seq", F.row_number().over(w)).withColumn("balance", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def latest_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("rn") <= n)


def fenced(attempts: DataFrame, resource: str, idx: str, token: str) -> DataFrame:
    """attempts with accepted: no greater token came before. A rejected token is lower than an accepted one, so the greatest of all is that of the accepted."""
    before = Window.partitionBy(resource).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("accepted", F.col(token) >= F.coalesce(F.max(token).over(before), F.col(token)))


def sessions(events: DataFrame, resource: str, order: str) -> DataFrame:
    """(resource, owner, session, start_ms, end_ms) from claim, renew and release events (event, at, expires_at): up to the last expiry, cut by a release."""
    w = Window.partitionBy(resource).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumn("session", F.sum(F.when(F.col("event") == "claim", 1).otherwise(0)).over(w)).filter("session > 0")
    released = F.min(F.when(F.col("event") == "release", F.col("at")))
    end = F.max(F.when(F.col("event") != "release", F.col("expires_at")))
    return marked.groupBy(resource, "session").agg(F.min_by("owner", order).alias("owner"), F.min("at").alias("start_ms"), F.least(end, F.coalesce(released, end)).alias("end_ms"))


def chunk_bounds(df: DataFrame, key: str, size: int, buckets: int = 4096) -> DataFrame:
    """(chunk, low, high, n): bounds of runs of `size` keys in order; key is a unique whole number.

    Keys fall into buckets of equal width, whose counts give each bucket's first number; rows
    are numbered inside their bucket only, so no task sees all keys. The bucket depends on the
    key alone, whatever the partitions.
    """
    keys = df.select(F.col(key).cast("long").alias("k"))
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    placed = keys.withColumn("b", F.expr(f"(k - {low or 0}L) div {width}L"))
    counted = placed.groupBy("b").agg(F.count("*").alias("c"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))  # at most `buckets` rows
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("k"))).join(F.broadcast(offsets), "b")
    chunk = F.expr(f"(i + before - 1) div {size}").alias("chunk")
    return numbered.select("k", chunk).groupBy("chunk").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))


def after(a: Column, b: Column, x, y) -> Column:
    """The row-tuple comparison (a, b) > (x, y)."""
    return (a > x) | ((a == x) & (b > y))


def sampled(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """A repeatable sample: keys whose hash falls into the share."""
    return df.filter(F.pmod(text_hash(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def picked(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows at random, the same for a seed: those of the smallest hashes, as a bounded sort."""
    return df.orderBy(text_hash(F.lit(seed), F.col(key)), key).limit(n)


def timeline(events: DataFrame, base: str) -> DataFrame:
    """(name, ms): time of each named event after the base event."""
    start = events.filter(F.col("name") == base).agg(F.min("ts").alias("t0"))
    return events.join(F.broadcast(start)).select("name", (F.col("ts") - F.col("t0")).alias("ms"))
