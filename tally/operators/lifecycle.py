"""Merges, moves and schema changes as functions from old tables to new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_first, name_last


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns of both, in the order of the source."""
    return [c for c in source.columns if c in target.columns]


def schema_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, only_in): columns that one of the two has, or that have different types."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, "a" if c not in right else "b" if c not in left else "type") for c in sorted({*left, *right}) if left.get(c) != right.get(c)]
    return a.sparkSession.createDataFrame(rows, "column_name string, only_in string")


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name; a column that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


# --- merges ---


def insert_ignored(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old win."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new win."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full-state upsert in one aggregate: for each key the row of the greatest priority, new over old."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_p").alias("_x"))
    return best.select(key, *[F.col("_x")[c].alias(c) for c in rest])


def backfilled(backfill: DataFrame, log: DataFrame, key: str, pos: str, deleted: Column) -> DataFrame:
    """A backfill with a concurrent log: the last log entry of a key wins over the backfill, and a deletion removes the key."""
    rest = [c for c in backfill.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest, deleted.alias("_gone")), pos).alias("_x"))
    kept = last.filter(~F.col("_x._gone")).select(key, *[F.col("_x")[c].alias(c) for c in rest])
    return backfill.join(last.select(key), key, "left_anti").unionByName(kept)


# --- soft deletion, mirrors, archives ---


def live(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted_at).isNull())


def cascade_flagged(parents: DataFrame, children: DataFrame, key: str, chosen: Column, stamp) -> tuple[DataFrame, DataFrame]:
    """Both tables with deleted_at set for the chosen parents and their children; what has a stamp keeps it."""
    flag = lambda hit: F.when(F.col("deleted_at").isNull() & hit, F.lit(stamp)).otherwise(F.col("deleted_at"))
    marks = parents.filter(chosen).select(key, F.lit(True).alias("_hit"))
    down = children.join(marks, key, "left").withColumn("deleted_at", flag(F.col("_hit").isNotNull())).drop("_hit")
    return parents.withColumn("deleted_at", flag(chosen)), down


def moved(table: DataFrame, keys: DataFrame, key: str, now, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows for the mirror with _moved_at and _reason)."""
    names = table.columns
    return table.join(keys, key, "left_anti").select(*names), table.join(keys, key, "left_semi").select(*names).withColumns({"_moved_at": F.lit(now), "_reason": F.lit(reason)})


def restored(table: DataFrame, mirror: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with the keys' rows back, mirror without them)."""
    back = mirror.join(keys, key, "left_semi").select(*table.columns)
    return table.unionByName(back), mirror.join(keys, key, "left_anti")


def parents_without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """NOT EXISTS guard: parents that no child refers to."""
    return parents.join(children.select(key), key, "left_anti")


def archived(table: DataFrame, due: Column, now, limit: int | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(live, archive): due rows leave, the first `limit` of them by order if there is a limit."""
    if limit is None:
        return table.filter(~due), table.filter(due).withColumn("_archived_at", F.lit(now))
    batch = table.filter(due).orderBy(order).limit(limit)
    return table.join(batch.select(order), order, "left_anti"), batch.withColumn("_archived_at", F.lit(now))


def purged(archive: DataFrame, as_of_ms, keep_ms: int) -> DataFrame:
    return archive.filter(F.col("_archived_at") >= as_of_ms - keep_ms)


def tombstoned(value: Column, key: Column, deleted: Column) -> Column:
    """The value, marked with its key where the row is deleted, so that it may be used again."""
    return F.when(deleted, F.concat(value, F.lit("#deleted#"), key.cast("string"))).otherwise(value)


# --- schema changes ---


def expanded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})


def needs_fix(name: str = "name") -> Column:
    """The derived parts are missing or disagree with the name. As in the reference only a null first part counts as missing."""
    first, last = name_first(F.col(name)), name_last(F.col(name))
    return F.col(name).isNotNull() & F.coalesce(F.col("first_name").isNull() | (F.col("first_name") != first) | (F.col("last_name") != last), F.lit(False))


def converged(df: DataFrame, name: str = "name") -> DataFrame:
    """One pass sets what needs a fix; a second pass finds nothing."""
    fix = needs_fix(name)
    return df.withColumns({"first_name": F.when(fix, name_first(F.col(name))).otherwise(F.col("first_name")), "last_name": F.when(fix, name_last(F.col(name))).otherwise(F.col("last_name"))})


def gate(checks: dict[str, DataFrame]) -> DataFrame:
    """(gate, violations, ok) from checks that give violating rows: a flip is allowed if all are ok."""
    parts = [d.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("ok")) for name, d in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- expiry ---


def ttl_swept(items: DataFrame, reservations: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """Overdue active reservations expire and give their capacity back. Sweeping again changes nothing."""
    overdue = (F.col("state") == "active") & (F.col("expires_at") < as_of_ms)
    freed = reservations.filter(overdue).groupBy("item_id").agg(F.count("*").alias("freed"))
    swept = reservations.withColumn("state", F.when(overdue, "expired").otherwise(F.col("state")))
    after = items.join(freed, "item_id", "left").withColumn("reserved", F.col("reserved") - F.coalesce("freed", F.lit(0))).drop("freed")
    return after, swept


def interleaved_ids(rank: Column, base: int, parity: int) -> Column:
    """The rank-th id (from 0) of one of two writers: every other number from base on."""
    return F.lit(base) + F.pmod(F.lit(parity - base), F.lit(2)) + rank * 2


def lossy_copy(rows: DataFrame, pos: str, cut: int) -> tuple[DataFrame, DataFrame]:
    """A copy made at a position and then switched to: (the copy, what was acked after it and is lost)."""
    return rows.filter(F.col(pos) <= cut), rows.filter(F.col(pos) > cut)


def incremental_copy(source: DataFrame, since: Column, write: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Rows since a point, and their write if one is given. The filter reaches the scan."""
    rows = source.filter(since)
    if write:
        write(rows)
    return rows
