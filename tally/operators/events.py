"""Change envelopes and event deliveries: actions, state, dedupe, quarantine, replay, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import first_of

# Envelope operations that carry a row image (snapshot read, create, update).
IMAGE_OPS = ("r", "c", "u")


def action(op: Column) -> Column:
    """upsert, delete, or skip for tombstones (null) and anything else."""
    return F.when(op.isin(*IMAGE_OPS), "upsert").when(op == "d", "delete").otherwise("skip")


def final_state(changes: DataFrame, key: str, pos: str, fields: list[str]) -> DataFrame:
    """(key, fields) after all changes (op, key, pos, fields): the last upsert or delete of each key, deleted keys gone. Redelivery changes nothing."""
    acts = changes.withColumn("_a", action(F.col("op"))).filter("_a <> 'skip'")
    last = acts.groupBy(key).agg(F.max_by(F.struct("_a", *fields), pos).alias("x"))
    return last.filter("x._a = 'upsert'").select(key, *[F.col("x")[f].alias(f) for f in fields])


def applied_log(table: DataFrame, log: DataFrame, key: str, pos: str, fields: list[str]) -> DataFrame:
    """A table with a log of r, c, u and d entries applied over it."""
    start = table.select(key, *fields, F.lit("r").alias("op"), F.lit(-1).cast("long").alias(pos))
    return final_state(start.unionByName(log.select(key, *fields, "op", F.col(pos).cast("long").alias(pos))), key, pos, fields)


def drained(log: DataFrame, pos: str, marker: DataFrame) -> DataFrame:
    """What stands at or before the marker row."""
    edge = marker.agg(F.min(pos).alias("_edge"))
    return log.join(F.broadcast(edge), F.col(pos) <= F.col("_edge")).drop("_edge")


def validated(messages: DataFrame, raw: str = "value") -> DataFrame:
    """messages with ok, event_id, account_id and amount: JSON with the three keys, the amount a whole number (booleans are refused)."""
    v = F.try_parse_json(raw)
    part = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.amount", "variant")) == "BIGINT", F.lit(False))
    ok = whole & part("event_id", "string").isNotNull() & part("account_id", "bigint").isNotNull()
    return messages.withColumns({"ok": ok, "event_id": part("event_id", "string"), "account_id": part("account_id", "bigint"), "amount": F.when(ok, part("amount", "bigint"))})


def applied_naively(deliveries: DataFrame, account: str, amount: str) -> DataFrame:
    """(account, total): every delivery counts."""
    return deliveries.groupBy(account).agg(F.sum(amount).cast("long").alias("total"))


def applied_once(deliveries: DataFrame, event: str, pos: str, account: str, amount: str) -> DataFrame:
    """(account, total): the first delivery of each event counts."""
    return applied_naively(first_of(deliveries, event, pos), account, amount)


def replayed(quarantine: DataFrame, truth: DataFrame, event: str, times: int = 1) -> tuple[DataFrame, DataFrame]:
    """(repaired events from the table of record, `times` each; quarantined ids that it doesn't know)."""
    known = truth.join(quarantine.select(event).distinct(), event, "left_semi")
    again = known.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return again, quarantine.join(truth.select(event), event, "left_anti")


def outbox_batch(outbox: DataFrame, n: int, published_at: str = "published_at", order: str = "id") -> DataFrame:
    return outbox.filter(F.col(published_at).isNull()).orderBy(order).limit(n)


def lag(applied: DataFrame, committed: str, seen: str, *by: str) -> DataFrame:
    """(by, n, mean_ms, max_ms) of the time from commit to effect."""
    ms = F.col(seen) - F.col(committed)
    return applied.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


def position_gate(consumers: DataFrame, captured: int) -> DataFrame:
    """(ready, slowest): whether every consumer is at or past a captured position."""
    return consumers.agg((F.min("pos") >= captured).alias("ready"), F.min("pos").alias("slowest"))


def lag_report(consumers: DataFrame, captured: int) -> DataFrame:
    return consumers.select("consumer", (F.lit(captured) - F.col("pos")).alias("behind"))


def caught_up(source: DataFrame, copied_to: int, overlap: int, pos: str) -> DataFrame:
    """The next pass of a catch-up: rows from the cursor on, less an overlap that may be copied twice."""
    return source.filter(F.col(pos) >= copied_to - overlap)


def invalidated(changes: DataFrame, key: str) -> DataFrame:
    """Distinct keys to drop from a cache."""
    return changes.filter(action(F.col("op")) != "skip").select(key).distinct()


def shadow_diffs(served: DataFrame, shadow: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys for which the shadow side answers otherwise than the serving one."""
    s, t = served.select(key, F.struct(*fields).alias("served")), shadow.select(key, F.struct(*fields).alias("shadow"))
    return s.join(t, key, "left").filter(~F.col("served").eqNullSafe(F.col("shadow"))).select(key, F.to_json("served").alias("served"), F.to_json("shadow").alias("shadow"))


def projected(changes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Row images as documents: each field cast to its type."""
    return changes.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields.items()])
