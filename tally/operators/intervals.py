"""Overlaps of intervals, spans with foreign rows, and sets of transaction intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(leases: DataFrame, resource: str, width_ms: int) -> DataFrame:
    """(resource, a, b, low, high): pairs of different owners whose half-open intervals meet.

    Intervals are cut into steps of width_ms, and pairs meet in the step where the later
    one starts, so a resource with many leases is not joined as a whole.
    """
    first, last = (F.floor(F.col(c) / width_ms) for c in ("start_ms", "end_ms"))
    cut = leases.withColumn("step", F.explode(F.sequence(first, last)))
    a, b = cut.alias("a"), cut.alias("b")
    met = a.join(b, [F.col(f"a.{resource}") == F.col(f"b.{resource}"), F.col("a.step") == F.col("b.step"), F.col("a.owner") < F.col("b.owner")])
    low, high = F.greatest("a.start_ms", "b.start_ms"), F.least("a.end_ms", "b.end_ms")
    return met.filter((low < high) & (F.floor(low / width_ms) == F.col("a.step"))).select(F.col(f"a.{resource}").alias(resource), F.col("a.owner").alias("a"), F.col("b.owner").alias("b"), low.alias("low"), high.alias("high"))


def interleaved(ledger: DataFrame, session: str, idx: str) -> DataFrame:
    """(session, foreign): sessions with rows of others between their first and last."""
    spans = ledger.groupBy(session).agg(F.count("*").alias("n"), F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    return spans.select(session, (F.col("hi") - F.col("lo") + 1 - F.col("n")).alias("foreign")).filter("foreign > 0")


def parsed_sets(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, uuid, lo, hi) of sets such as uuid:1-5:7,uuid:1-3."""
    parts = df.select(*keep, F.explode(F.split(F.regexp_replace(F.col(text), r"\s", ""), ",")).alias("p")).filter("p <> ''")
    ranges = parts.select(*keep, F.substring_index("p", ":", 1).alias("uuid"), F.explode(F.slice(F.split("p", ":"), F.lit(2), F.size(F.split("p", ":")) - 1)).alias("r"))
    return ranges.select(*keep, "uuid", F.substring_index("r", "-", 1).cast("long").alias("lo"), F.substring_index("r", "-", -1).cast("long").alias("hi"))


def merged_sets(sets: DataFrame, *by: str) -> DataFrame:
    """(by, uuid, lo, hi): the union, as ranges that neither meet nor touch."""
    w = Window.partitionBy(*by, "uuid").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = sets.withColumn("new", F.when(F.coalesce(F.col("lo") > top + 1, F.lit(True)), 1).otherwise(0))
    grouped = starts.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*by, "uuid", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def set_size(sets: DataFrame, *by: str) -> DataFrame:
    """(by, n): the sum over ranges of hi - lo + 1."""
    return sets.groupBy(*by).agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("n"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(uuid, lo, hi): what of a isn't in b, by the edges of both; no range is expanded."""
    edges = lambda d, da, db: merged_sets(d.select("uuid", "lo", "hi")).select("uuid", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(da).alias("da"), F.lit(db).alias("db")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-da).alias("da"), F.lit(-db).alias("db")))).alias("e")).select("uuid", "e.x", "e.da", "e.db")
    both = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy("uuid", "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy("uuid").orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = both.select("uuid", F.col("x").alias("lo"), (F.lead("x").over(w) - 1).alias("hi"), F.sum("da").over(run).alias("in_a"), F.sum("db").over(run).alias("in_b"))
    return merged_sets(state.filter("in_a > 0 AND in_b = 0").select("uuid", "lo", "hi"))


def largest_set(nodes: DataFrame, node: str) -> DataFrame:
    """(node, n): nodes whose set holds every other's; no row if two sets are incomparable. nodes has (node, uuid, lo, hi).

    A union as large as a set means that it holds all of them.
    """
    merged = merged_sets(nodes.select(node, "uuid", "lo", "hi"), node)
    whole = set_size(merged_sets(nodes.select("uuid", "lo", "hi"))).withColumnRenamed("n", "whole")
    return set_size(merged, node).join(F.broadcast(whole)).filter("n = whole").select(node, "n")


def contains(lo: Column, hi: Column, x: Column) -> Column:
    return (x >= lo) & (x <= hi)
