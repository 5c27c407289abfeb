"""Diffs, fingerprints and audits of two sides of the same data.

Every check returns the rows that violate it, so an empty result is a pass; each works on
keys by hash joins or aggregates and never collects a side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import text_hash


def _differs(fields: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (~F.col(f"s.{f}").eqNullSafe(F.col(f"t.{f}")) for f in fields))


def classified(source: DataFrame, target: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, class): missing in the target, stale in it, or orphan there."""
    s, t = (d.select(key, *fields, F.lit(True).alias("here")).alias(n) for d, n in ((source, "s"), (target, "t")))
    joined = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    kind = F.when(F.col("t.here").isNull(), "missing").when(F.col("s.here").isNull(), "orphan").when(_differs(fields), "stale")
    return joined.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), kind.alias("class")).filter(F.col("class").isNotNull())


def repaired(source: DataFrame, target: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The target with missing and stale rows taken from the source and orphans gone."""
    classes = classified(source, target, key, fields)
    wrong = classes.select(key)
    upserts = source.join(classes.filter("class IN ('missing', 'stale')"), key, "left_semi")
    return target.join(wrong, key, "left_anti").select(key, *fields).unionByName(upserts.select(key, *fields))


def store_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that one side only has."""
    only = lambda x, y, side: x.select(key).join(y.select(key), key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def xor_presence(ids: DataFrame, live: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """(key, in_live, in_archive): ids that aren't on exactly one side."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    joined = ids.select(key).join(flag(live, "l"), key, "left").join(flag(archive, "a"), key, "left")
    return joined.select(key, F.coalesce("l", F.lit(False)).alias("in_live"), F.coalesce("a", F.lit(False)).alias("in_archive")).filter("in_live = in_archive")


def exactly_once(journal: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """(key, journaled, applied): ids that don't have one entry on each side."""
    count = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    both = count(journal, "journaled").join(count(applied, "applied"), key, "full_outer").na.fill(0, ["journaled", "applied"])
    return both.filter("journaled <> 1 OR applied <> 1")


def unaccounted(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, only_in): ids that are in one of the two sets."""
    e, f = (d.select(key).distinct().withColumn(n, F.lit(1)) for d, n in ((expected, "e"), (found, "f")))
    return e.join(f, key, "full_outer").filter("e IS NULL OR f IS NULL").select(key, F.when(F.col("f").isNull(), "expected").otherwise("found").alias("only_in"))


def acked_audit(acked: DataFrame, stored: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, outcome): missing, stale (a lower version is stored) or ok, by the last acked version of each key."""
    last = acked.groupBy(*keys).agg(F.max(version).alias("acked"))
    joined = last.join(stored.select(*keys, F.col(version).alias("has")), keys, "left")
    return joined.select(*keys, F.when(F.col("has").isNull(), "missing").when(F.col("has") < F.col("acked"), "stale").otherwise("ok").alias("outcome"))


def fingerprint(df: DataFrame, by: list[str], columns: list[str], hashed=text_hash) -> DataFrame:
    """(by, n, print): rows of each group and the sum of their content hashes, in any order."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hashed(*[F.col(c) for c in columns])).cast("long").alias("print"))


def crc_fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """fingerprint() with CRC-32, the hash that row stores have."""
    return fingerprint(df, by, columns, lambda *c: F.crc32(F.concat_ws("#", *[x.cast("string") for x in c]).cast("binary")))


def range_checksum(df: DataFrame, key: str, width: int, columns: list[str]) -> DataFrame:
    """(bucket, n, sum): an MD5 over the rows of each range of keys, in key order. A range is bounded by its width."""
    line = F.concat_ws("#", *[F.col(c).cast("string") for c in columns])
    rows = df.select(F.expr(f"{key} div {width}").alias("bucket"), F.col(key).alias("_k"), line.alias("_x"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("md5(listagg(_x, ',') WITHIN GROUP (ORDER BY _k))").alias("checksum"))


def family_digest(parents: DataFrame, children: DataFrame, key: str, parent_line: Column, child_order: str, child_line: Column) -> DataFrame:
    """(key, digest): 16 hex digits of a SHA-256 over a parent and its children in order."""
    own = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(child_order).alias("o"), child_line.alias("x")))).alias("c"))
    joined = parents.select(key, parent_line.alias("p")).join(own, key, "left")
    lines = F.concat(F.array("p"), F.coalesce(F.transform("c", lambda x: x["x"]), F.array().cast("array<string>")))
    return joined.select(key, F.substring(F.sha2(F.array_join(lines, "|"), 256), 1, 16).alias("digest"))


def drift_split(expected: DataFrame, actual: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(totals, drifts): over-applied and lost totals with the count of wrong keys, and (key, drift) of those; both sides have (key, cents)."""
    d = expected.select(key, F.col("cents").alias("e")).join(actual.select(key, F.col("cents").alias("a")), key)
    drift = d.select(key, (F.col("a") - F.col("e")).alias("drift")).filter("drift <> 0")
    sums = drift.agg(F.coalesce(F.sum(F.when(F.col("drift") > 0, F.col("drift"))), F.lit(0)).cast("long").alias("over"), F.coalesce(F.sum(F.when(F.col("drift") < 0, -F.col("drift"))), F.lit(0)).cast("long").alias("lost"), F.count("*").alias("wrong"))
    return sums, drift


def implied_balance(opening: DataFrame, transfers: DataFrame) -> DataFrame:
    """(account, cents): opening balance less debits plus credits; transfers have (src, dst, cents)."""
    moves = transfers.select(F.explode(F.array(F.struct(F.col("src").alias("account"), (-F.col("cents")).alias("m")), F.struct(F.col("dst").alias("account"), F.col("cents").alias("m")))).alias("x")).select("x.account", "x.m")
    net = moves.groupBy("account").agg(F.sum("m").alias("net"))
    return opening.join(net, "account", "left").select("account", (F.col("cents") + F.coalesce("net", F.lit(0))).cast("long").alias("cents"))


def conservation(stores: dict[str, DataFrame], total: int) -> DataFrame:
    """(store, total, negatives, ok): whether each balance store sums to the total and has no negative row."""
    parts = [d.agg(F.sum("cents").cast("long").alias("total"), F.count(F.when(F.col("cents") < 0, 1)).alias("negatives")).withColumn("store", F.lit(name)) for name, d in stores.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", (F.col("total") == total) & (F.col("negatives") == 0)).select("store", "total", "negatives", "ok")


def state_histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
