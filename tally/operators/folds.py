"""Outcomes that depend on the order of operations.

Where an outcome is a rank or a sum it is a window; where each step needs the state that
the last one left, it is a fold over the operations of one group, and groups run in
parallel. Transfers touch two accounts, so their group is a component of accounts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import Generator, NaiveGenerator, scripted


def reserved(requests: DataFrame, items: DataFrame, item: str, order: list[str]) -> DataFrame:
    """requests with accepted: the first `capacity` distinct requests of an item, in order. A repeated id is not accepted again."""
    seen = Window.partitionBy(item, "reservation_id").orderBy(*order)
    firsts = requests.withColumn("_again", F.row_number().over(seen) > 1)
    place = F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(Window.partitionBy(item).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = firsts.withColumn("_place", place).join(items.select(item, "capacity"), item, "left")
    return joined.withColumn("accepted", F.coalesce(~F.col("_again") & (F.col("_place") <= F.col("capacity")), F.lit(False))).drop("_again", "_place", "capacity")


def committed(items: DataFrame, reservations: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active reservations that are asked for become committed, and move from reserved to sold. Asking twice changes nothing."""
    asked = commits.select("reservation_id").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("state") == "active")
    joined = reservations.join(asked, "reservation_id", "left").withColumn("_hit", hit)
    moved = joined.filter("_hit").groupBy("item_id").agg(F.count("*").alias("_n"))
    after = items.join(moved, "item_id", "left").withColumn("reserved", F.col("reserved") - F.coalesce("_n", F.lit(0))).withColumn("sold", F.col("sold") + F.coalesce("_n", F.lit(0))).drop("_n")
    return after, joined.withColumn("state", F.when(F.col("_hit"), "committed").otherwise(F.col("state"))).drop("_asked", "_hit")


def reservation_gates(items: DataFrame, reservations: DataFrame) -> DataFrame:
    """(item_id, oversold, wrong_counter): items with more active and committed rows than capacity, or counters that differ from the rows."""
    counts = reservations.groupBy("item_id").agg(F.count(F.when(F.col("state") == "active", 1)).alias("a"), F.count(F.when(F.col("state") == "committed", 1)).alias("c"))
    j = items.join(counts, "item_id", "left").na.fill(0, ["a", "c"])
    return j.select("item_id", (F.col("a") + F.col("c") > F.col("capacity")).alias("oversold"), ((F.col("a") != F.col("reserved")) | (F.col("c") != F.col("sold"))).alias("wrong_counter")).filter("oversold OR wrong_counter")


def transfers(opening: DataFrame, ops: DataFrame, group: str) -> DataFrame:
    """(group, op, src, dst, cents, ok): each transfer happens if its source has the amount. opening has (group, account, cents), ops (group, op, src, dst, cents) in the order of op."""

    def fold(key, accounts, rows):
        balance = dict(zip(accounts["account"].tolist(), accounts["cents"].tolist(), strict=True))
        rows = rows.sort_values("op")
        ok = []
        for s, d, c in zip(rows["src"].tolist(), rows["dst"].tolist(), rows["cents"].tolist(), strict=True):
            fine = balance.get(s, 0) >= c
            if fine:
                balance[s] -= c
                balance[d] = balance.get(d, 0) + c
            ok.append(fine)
        return rows[[group, "op", "src", "dst", "cents"]].assign(ok=ok)

    kind = ops.schema[group].dataType.simpleString()
    a, b = opening.select(group, "account", "cents"), ops.select(group, "op", "src", "dst", "cents")
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInPandas(fold, f"{group} {kind}, op long, src long, dst long, cents long, ok boolean")


def naive_transfers(opening: DataFrame, ops: DataFrame, group: str) -> DataFrame:
    """(group, account, cents) when every op of a round sees the balances at its start and the last write wins. ops also has round."""

    def fold(key, accounts, rows):
        balance = dict(zip(accounts["account"].tolist(), accounts["cents"].tolist(), strict=True))
        for _, part in rows.sort_values(["round", "op"]).groupby("round", sort=True):
            start = dict(balance)
            for s, d, c in zip(part["src"].tolist(), part["dst"].tolist(), part["cents"].tolist(), strict=True):
                if start.get(s, 0) >= c:
                    balance[s], balance[d] = start.get(s, 0) - c, start.get(d, 0) + c
        return pd.DataFrame({group: key[0], "account": list(balance), "cents": list(balance.values())})

    kind = ops.schema[group].dataType.simpleString()
    a, b = opening.select(group, "account", "cents"), ops.select(group, "round", "op", "src", "dst", "cents")
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInPandas(fold, f"{group} {kind}, account long, cents long")


def entries(done: DataFrame) -> DataFrame:
    """(op, account, cents): a debit and a credit for each transfer that happened."""
    both = F.array(F.struct(F.col("src").alias("account"), (-F.col("cents")).alias("cents")), F.struct(F.col("dst").alias("account"), F.col("cents").alias("cents")))
    return done.filter("ok").select("op", F.explode(both).alias("x")).select("op", "x.account", "x.cents")


def cache_replay(ops: DataFrame, key: str, strategy: str, ttl_ms: int, lag_ms: int = 0) -> DataFrame:
    """(key, ts, price, source) of every read in a log of reads and writes (key, ts, pos, op, price) under a cache strategy.

    ttl lets entries lapse; delete drops the entry with each write; versioned moves readers to
    a new entry; cdc drops it lag_ms after the write.
    """
    if strategy not in ("ttl", "delete", "versioned", "cdc"):
        raise ValueError(strategy)

    def fold(k, rows):
        stored, cached, lapses, version, entry_version = None, None, 0, 1, 1
        pending: list[int] = []
        out = []
        for ts, op, price in rows.sort_values(["ts", "pos"])[["ts", "op", "price"]].itertuples(index=False):
            while pending and pending[0] <= ts:
                pending.pop(0)
                cached = None
            if op == "write":
                stored = price
                if strategy == "delete":
                    cached = None
                elif strategy == "versioned":
                    version += 1
                elif strategy == "cdc":
                    pending.append(ts + lag_ms)
                continue
            if stored is None:
                continue  # nothing to read yet
            if cached is not None and ts < lapses and entry_version == version:
                out.append((k[0], ts, cached, "cache"))
            else:
                cached, lapses, entry_version = stored, ts + ttl_ms, version
                out.append((k[0], ts, stored, "db"))
        return pd.DataFrame(out, columns=[key, "ts", "price", "source"])

    kind = ops.schema[key].dataType.simpleString()
    return ops.select(key, "ts", "pos", "op", "price").groupBy(key).applyInPandas(fold, f"{key} {kind}, ts long, price double, source string")


def generated_ids(clock: DataFrame, worker: str, policy: str, wait_max_ms: int = 500) -> DataFrame:
    """(worker, pos, id): what a generator of the policy (naive, error, wait, hold) issues for a log of clock readings (worker, pos, ts)."""

    def fold(key, rows):
        steps = rows.sort_values("pos")["ts"].tolist()
        read = scripted(steps)
        gen = NaiveGenerator(int(key[0]), read) if policy == "naive" else Generator(int(key[0]), read, policy, wait_max_ms)
        out = gen.issued(len(steps))
        return pd.DataFrame({worker: key[0], "pos": range(len(out)), "id": out})

    kind = clock.schema[worker].dataType.simpleString()
    return clock.select(worker, "pos", "ts").groupBy(worker).applyInPandas(fold, f"{worker} {kind}, pos long, id long")
