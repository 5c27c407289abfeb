"""Generated inputs: seeded streams, series, plans of operations."""

from __future__ import annotations

import bisect
import itertools
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SCRAMBLE, minute_of, scrambled


def zipf_ids(n_events: int, n_keys: int, s: float = 1.1, seed: int = 14) -> list[int]:
    """Scrambled ranks drawn one by one from a seeded uniform generator: the parity stream, on the driver."""
    edges = list(itertools.accumulate(rank**-s for rank in range(1, n_keys + 1)))
    uniform = random.Random(seed).random
    return [(bisect.bisect_left(edges, uniform() * edges[-1]) + 1) * SCRAMBLE & 0xFFFFFFFF for _ in range(n_events)]


def zipf_stream(spark: SparkSession, n_events: int, n_keys: int, s: float = 1.1, seed: int = 14, parts: int = 8) -> DataFrame:
    """(pos, key) of the same law in parallel, by the inverse of its continuous form; not the parity draws."""
    u = F.rand(seed)
    top = float(n_keys + 1)
    rank = F.floor(F.pow(u * (top ** (1 - s) - 1) + 1, F.lit(1 / (1 - s)))) if s != 1 else F.floor(F.exp(u * F.log(F.lit(top))))
    return spark.range(0, n_events, 1, parts).select(F.col("id").alias("pos"), scrambled(F.least(F.greatest(rank.cast("long"), F.lit(1)), F.lit(n_keys))).alias("key"))


def with_minutes(events: DataFrame, n: int, minutes: int = 60) -> DataFrame:
    return events.withColumn("minute", minute_of(F.col("pos"), n, minutes))


def trap(spark: SparkSession, minutes: int = 60) -> DataFrame:
    """(minute, key, cnt): two giants of 40 a minute, 15 keys of 30 in one minute each, one steady key of 20 that no minute shows."""
    each = spark.range(minutes).select(F.col("id").alias("minute"))
    struct = lambda key, n: F.struct(key.cast("long").alias("key"), F.lit(n).cast("long").alias("cnt"))
    fixed = [struct(F.lit(1), 40), struct(F.lit(2), 40), struct(F.lit(3), 20)]
    local = [struct(1000 + 100 * F.col("minute") + j, 30) for j in range(15)]
    return each.select("minute", F.inline(F.array(*fixed, *local)))


def series(spark: SparkSession, n: int, shards: int = 2) -> DataFrame:
    """(id, shard, body, age_s) for 1 to n."""
    i = F.col("id")
    return spark.range(1, n + 1).select(i, F.pmod(i, F.lit(shards)).alias("shard"), F.md5(i.cast("string")).alias("body"), F.pmod(i * 37, F.lit(86_400)).alias("age_s"))


def transfer_plan(spark: SparkSession, rounds: int, workers: int, hot: int = 4) -> DataFrame:
    """(round, worker, src, dst, cents): a round shares its source; destinations and amounts differ by worker, and each hot-th round asks for too much."""
    r, w = F.col("round"), F.col("worker")
    grid = spark.range(rounds * workers).select(F.floor(F.col("id") / workers).alias("round"), F.pmod("id", F.lit(workers)).alias("worker"))
    src = F.pmod(r, F.lit(hot))
    places = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.pmod(r + w + k, F.lit(hot))), lambda x: x != src)
    base = F.when(src == 0, 40_000).otherwise(500)
    return grid.select("round", "worker", (src + 1).alias("src"), (places[0] + 1).alias("dst"), (base + 100 * w).cast("long").alias("cents"))


def contiguous(spark: SparkSession, users: int, per_user: int) -> DataFrame:
    """(user_id, seq) with seq from 1 without gaps."""
    return spark.range(users * per_user).select((F.floor(F.col("id") / per_user) + 1).alias("user_id"), (F.pmod("id", F.lit(per_user)) + 1).alias("seq"))


def write_mix(spark: SparkSession, n: int, shares: dict[str, float], keys: int, seed: int = 1) -> DataFrame:
    """(pos, op, key): operations in the given shares over a number of keys."""
    op, floor, u = F.lit(list(shares)[-1]), 0.0, F.col("u")
    marks = []
    for name, share in shares.items():
        floor += share
        marks.append((name, floor))
    for name, edge in reversed(marks[:-1]):
        op = F.when(u < edge, name).otherwise(op)
    return spark.range(n).select(F.col("id").alias("pos"), F.rand(seed).alias("u"), F.floor(F.rand(seed + 1) * keys).alias("key")).select("pos", op.alias("op"), "key")


def with_poison(messages: DataFrame, every: int, pos: str, value: str = "value") -> DataFrame:
    """Each every-th message has its amount as a string."""
    bad = F.regexp_replace(value, r'("amount"\s*:\s*)(-?\d+)', '$1"$2"')
    return messages.withColumn(value, F.when(F.pmod(F.col(pos), F.lit(every)) == 0, bad).otherwise(F.col(value)))


def published(events: DataFrame, crash_every: int, outbox: bool, pos: str = "pos") -> DataFrame:
    """What reaches a topic when the writer crashes at every n-th event between its commit and its publish: a dual write loses the event, an outbox publishes it later, twice if the crash came before the mark."""
    crashed = F.pmod(F.col(pos), F.lit(crash_every)) == 0
    if not outbox:
        return events.filter(~crashed)
    return events.unionByName(events.filter(crashed & (F.pmod(F.col(pos), F.lit(2 * crash_every)) == 0)))


def with_duplicates(events: DataFrame, share: float, key: str) -> DataFrame:
    """Deliveries: all events, and a hashed share of them twice."""
    again = events.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
    return events.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))
