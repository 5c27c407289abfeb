"""Connected components over an edge table, by alternating large-star and small-star rounds.

Edges and labels stay in DataFrames; each round is written to the shared folder, and only
a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROUNDS = 60
ROWS_PER_TASK = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each neighbour above a node is linked to the smallest around the node. Small: the node and each neighbour below are."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of edges (u long, v long) that isn't a root itself."""
    edges = C.staged(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    # A round gives no more edges than it gets, so their number says how many tasks are worth while.
    tasks = -(-max(1, edges.count()) // ROWS_PER_TASK)
    before = None
    for _ in range(MAX_ROUNDS):
        edges = C.staged(_star(_star(edges, large=True), large=False).coalesce(tasks), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
