"""Where an operation goes, and whether rows are where they belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The modes, from one node to shards.
MODES = ("single", "double-write", "shadow-read", "sharded")


def routed(ops: DataFrame, mode: Column, shard: Column) -> DataFrame:
    """ops (op, ...) with node and leg, a row for each node that an op touches.

    Writes: the authoritative leg, and from double-write on a best-effort upsert on the other
    side. Reads: the authoritative node, in shadow-read the other one too.
    """
    own, other = F.when(mode == "sharded", shard).otherwise("mono"), F.when(mode == "sharded", F.lit("mono")).otherwise(shard)
    leg = lambda node, name: F.struct(node.alias("node"), F.lit(name).alias("leg"))
    second = F.when(F.col("op") == "read", F.when(mode == "shadow-read", leg(other, "shadow"))).otherwise(F.when(mode != "single", leg(other, "best-effort")))
    legs = F.filter(F.array(leg(own, "authoritative"), second), lambda x: x.isNotNull())
    return ops.withColumn("_l", F.explode(legs)).select(*ops.columns, "_l.node", "_l.leg")


def gated(ops: DataFrame, gates: DataFrame, at: str) -> DataFrame:
    """ops with released_at: those inside a gate (low, high) wait for its end. Gates are few: one row for each cutover."""
    joined = ops.join(F.broadcast(gates), (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high")), "left")
    return joined.withColumn("released_at", F.coalesce("high", at)).drop("low", "high")


def shard_name(index: Column) -> Column:
    return F.concat(F.lit("shard"), index.cast("string"))


def misplaced(rows: DataFrame, shard: str, owner: Column) -> DataFrame:
    return rows.filter(F.col(shard) != owner)


def shard_counts(shards: DataFrame, shard: str, reference: DataFrame) -> DataFrame:
    """(shards, reference, ok): the shards' rows together against the reference's."""
    a, b = shards.agg(F.count("*").alias("shards")), reference.agg(F.count("*").alias("reference"))
    return a.join(F.broadcast(b)).withColumn("ok", F.col("shards") == F.col("reference"))
