"""Change envelopes, deliveries, quarantine, lag: the batch forms of the event paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..sources.journals import append_jsonl, scratch
from ..streaming.ledger import IdempotentLedger, Projection
from ..operators import sequences
from . import fixtures as X
from .fixtures import Tables
from .registry import query

_ACTION = "CASE WHEN op IN ('r', 'c', 'u') THEN 'upsert' WHEN op = 'd' THEN 'delete' ELSE 'skip' END"
_STATE = f"""{X.CHANGES}, ac AS (SELECT *, {_ACTION} AS action FROM ch), la AS (SELECT key, arg_max(action, pos) AS action, arg_max(k, pos) AS k FROM ac WHERE action <> 'skip' GROUP BY 1)"""


@query(f"WITH {X.CHANGES} SELECT pos, {_ACTION} AS action FROM ch")
def cdc_actions(t: Tables) -> DataFrame:
    return X.changes(t).select("pos", E.action(F.col("op")).alias("action"))


@query(f"WITH {X.CHANGES} SELECT pos, key::INT AS id, k::DOUBLE AS amount, ms AS updated_at FROM ch")
def cdc_project(t: Tables) -> DataFrame:
    images = X.changes(t).select("pos", F.col("key").cast("string").alias("id"), F.col("k").cast("string").alias("amount"), F.col("ms").alias("updated_at"))
    return E.projected(images, {"pos": "long", "id": "int", "amount": "double", "updated_at": "long"})


@query(f"WITH {_STATE} SELECT key, k FROM la WHERE action = 'upsert'")
def cdc_final_state(t: Tables) -> DataFrame:
    return E.final_state(X.changes(t), "key", "pos", ["k"])


@query(f"WITH {_STATE} SELECT key, k FROM la WHERE action = 'upsert'")
def cdc_replayed(t: Tables) -> DataFrame:
    """The same state when everything is delivered twice."""
    c = X.changes(t)
    return E.final_state(c.unionByName(c), "key", "pos", ["k"])


@query(f"""WITH {_STATE}, tb AS (SELECT DISTINCT key + 100 AS key, -1 AS k FROM e)
SELECT key, k FROM la WHERE action = 'upsert' UNION ALL SELECT key, k
FROM tb ANTI JOIN la USING (key)""")
def cdc_apply(t: Tables) -> DataFrame:
    c = X.changes(t)
    table = c.select((F.col("key") + 100).alias("key"), F.lit(-1).alias("k")).distinct()
    return E.applied_log(table, c, "key", "pos", ["k"])


@query(f"""WITH {X.CHANGES} SELECT op, count(*) AS n, round(avg(k * 10 + 5), 6) AS mean_ms, max(k * 10 + 5)::BIGINT AS max_ms
FROM ch WHERE op IS NOT NULL GROUP BY 1""")
def cdc_lag(t: Tables) -> DataFrame:
    c = X.changes(t).filter("op IS NOT NULL").withColumn("seen", F.col("ms") + F.col("k") * 10 + 5)
    return E.lag(c, "ms", "seen", "op").withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"WITH {X.EVENTS} SELECT pos, key FROM e WHERE pos <= (SELECT min(pos) FROM e WHERE kind = 'error' AND k = 7)")
def drain_to_marker(t: Tables) -> DataFrame:
    e = X.events(t)
    return E.drained(e, "pos", e.filter("kind = 'error' AND k = 7")).select("pos", "key")


@query(f"WITH {X.CHANGES} SELECT DISTINCT key FROM ch WHERE {_ACTION} <> 'skip'")
def invalidate_keys(t: Tables) -> DataFrame:
    return E.invalidated(X.changes(t), "key")


@query(f"WITH {X.DELIVERIES} SELECT customer, sum(cents)::BIGINT AS total FROM d GROUP BY 1")
def apply_naive(t: Tables) -> DataFrame:
    return E.applied_naively(X.deliveries(t), "customer", "cents")


@query(f"WITH {X.DELIVERIES} SELECT customer, sum(cents)::BIGINT AS total FROM (SELECT DISTINCT id, customer, cents FROM d) GROUP BY 1")
def apply_idempotent(t: Tables) -> DataFrame:
    return E.applied_once(X.deliveries(t), "id", "pos", "customer", "cents")


@query(f"WITH {X.EVENTS} SELECT pos, NOT {X.POISON} AS ok, CASE WHEN NOT {X.POISON} THEN k ELSE -1 END::BIGINT AS amount FROM e")
def poison_split(t: Tables) -> DataFrame:
    return E.validated(X.messages(t)).select("pos", "ok", F.coalesce("amount", F.lit(-1)).alias("amount"))


@query(f"""WITH {X.EVENTS} SELECT 'e' || pos AS event_id, key AS account_id, k::BIGINT AS amount
FROM e WHERE {X.POISON} AND pos % 67 <> 0 AND pos % 2 = 0""")
def dlq_repair(t: Tables) -> DataFrame:
    """Quarantined events as the table of record has them; it knows the even ones."""
    parsed = E.validated(X.messages(t))
    truth = X.events(t).filter("pos % 2 = 0").select(F.concat(F.lit("e"), F.col("pos").cast("string")).alias("event_id"), F.col("key").alias("account_id"), F.col("k").cast("long").alias("amount"))
    again, _ = E.replayed(parsed.filter("NOT ok AND event_id IS NOT NULL").select("event_id"), truth, "event_id")
    return again.select("event_id", "account_id", "amount")


@query(f"WITH {X.EVENTS} SELECT key AS account_id, sum(k)::BIGINT AS total FROM e WHERE NOT {X.POISON} OR pos % 67 <> 0 GROUP BY 1")
def dlq_replay_noop(t: Tables) -> DataFrame:
    """Balances after the quarantine is replayed three times."""
    parsed = E.validated(X.messages(t))
    truth = X.events(t).select(F.concat(F.lit("e"), F.col("pos").cast("string")).alias("event_id"), F.col("key").alias("account_id"), F.col("k").cast("long").alias("amount"))
    again, _ = E.replayed(parsed.filter("NOT ok AND event_id IS NOT NULL").select("event_id"), truth, "event_id", 3)
    good = parsed.filter("ok").select("event_id", "account_id", "amount", F.lit(0).alias("attempt"))
    return E.applied_once(good.unionByName(again.select("event_id", "account_id", "amount", "attempt")), "event_id", "attempt", "account_id", "amount")


@query(f"WITH {X.EVENTS} SELECT pos AS id FROM e WHERE k % 3 <> 0 ORDER BY pos LIMIT 500")
def outbox_batch(t: Tables) -> DataFrame:
    outbox = X.events(t).select(F.col("pos").alias("id"), F.when(F.col("k") % 3 == 0, F.col("ms")).alias("published_at"))
    return E.outbox_batch(outbox, 500).select("id")


@query(f"""WITH {X.EVENTS}, c AS (SELECT key % 5 AS consumer, max(pos) AS pos FROM e GROUP BY 1)
SELECT min(pos) >= 9000 AS ready, min(pos) AS slowest FROM c""")
def lsn_gate(t: Tables) -> DataFrame:
    return E.position_gate(X.events(t).groupBy((F.col("key") % 5).alias("consumer")).agg(F.max("pos").alias("pos")), 9000)


@query(f"WITH {X.EVENTS} SELECT key % 5 AS consumer, 20000 - max(pos) AS behind FROM e GROUP BY 1")
def lag_report(t: Tables) -> DataFrame:
    return E.lag_report(X.events(t).groupBy((F.col("key") % 5).alias("consumer")).agg(F.max("pos").alias("pos")), 20_000)


@query(f"WITH {X.EVENTS} SELECT key, arg_max(k, pos) AS k FROM e GROUP BY 1")
def catchup_overlap(t: Tables) -> DataFrame:
    """Two passes that overlap give the last state of each key, once."""
    e = X.events(t).select("pos", "key", "k")
    first = e.filter("pos < 6000")
    second = E.caught_up(e, 6000, 500, "pos")
    return sequences.last_of(first.unionByName(second), ["key"], "pos").select("key", "k")


@query(f"""WITH {X.EVENTS}, w AS (SELECT key, arg_max(k, pos) AS k FROM e WHERE pos >= 7000 GROUP BY 1),
o AS (SELECT key, arg_max(k, pos) AS k FROM e WHERE pos < 7000 GROUP BY 1)
SELECT key, k FROM w UNION ALL SELECT key, k FROM o ANTI JOIN w USING (key)""")
def reverse_catchup(t: Tables) -> DataFrame:
    """Writes since a cutover replayed onto the old copy."""
    e = X.events(t).select("pos", "key", "k")
    last = lambda d: sequences.last_of(d, ["key"], "pos").select("key", "k")
    from ..operators.lifecycle import replaced

    return replaced(last(e.filter("pos < 7000")), last(e.filter("pos >= 7000")), "key")


@query(f"""WITH {X.EVENTS}, l AS (SELECT key, arg_max(kind, pos) AS kind, arg_max(k, pos) AS k, count(*) AS ops FROM e GROUP BY 1)
SELECT key, kind, k, ops FROM l""")
def journal_final(t: Tables) -> DataFrame:
    e = X.events(t)
    return e.groupBy("key").agg(F.max_by("kind", "pos").alias("kind"), F.max_by("k", "pos").alias("k"), F.count("*").alias("ops"))


@query(f"""WITH {X.EVENTS}, l AS (SELECT key, arg_max(kind, pos) AS kind FROM e GROUP BY 1)
SELECT count(*) FILTER (WHERE kind <> 'error' AND key >= 50) AS inserts_alive, count(*) FILTER (WHERE kind = 'error' AND key < 50) AS seeded_deleted
FROM l""")
def count_reconcile(t: Tables) -> DataFrame:
    last = X.events(t).groupBy("key").agg(F.max_by("kind", "pos").alias("kind"))
    gone = F.col("kind") == "error"
    return last.agg(F.count(F.when(~gone & (F.col("key") >= 50), 1)).alias("inserts_alive"), F.count(F.when(gone & (F.col("key") < 50), 1)).alias("seeded_deleted"))


@query(f"WITH {X.EVENTS} SELECT key AS id, max(ms) AS version FROM e GROUP BY 1")
def max_version(t: Tables) -> DataFrame:
    return X.events(t).groupBy(F.col("key").alias("id")).agg(F.max("ms").alias("version"))


@query(f"WITH {X.EVENTS} SELECT kind AS label, arg_max(k, pos) AS k, max(pos) AS pos FROM e GROUP BY 1")
def latest_per_label(t: Tables) -> DataFrame:
    return sequences.last_of(X.events(t).select(F.col("kind").alias("label"), "k", "pos").withColumn("o", F.col("pos")), ["label"], "o").select("label", "k", "pos")


@query(f"""WITH {X.EVENTS}, q AS (SELECT pos, key, k, key % 3 AS target FROM e WHERE kind = 'error'),
rp AS (SELECT key, arg_max(k, pos) AS k FROM q WHERE target <> 2 GROUP BY 1)
SELECT key, k, 'applied' AS side FROM rp UNION ALL SELECT key, k, 'kept'
FROM q WHERE target = 2""")
def repair_queue(t: Tables) -> DataFrame:
    """A repair queue replayed for two of three targets, the rest kept."""
    q = X.events(t).filter("kind = 'error'").withColumn("target", F.col("key") % 3)
    applied = sequences.last_of(q.filter("target <> 2").select("key", "k", "pos"), ["key"], "pos").select("key", "k", F.lit("applied").alias("side"))
    return applied.unionByName(q.filter("target = 2").select("key", "k", F.lit("kept").alias("side")))


# --- the same as streams: files in, micro-batches, one version of the state a batch ---


@query(f"WITH {X.EVENTS} SELECT key AS account_id, sum(k)::BIGINT AS total FROM e WHERE NOT {X.POISON} GROUP BY 1")
def stream_ledger(t: Tables) -> DataFrame:
    """Balances from a stream of messages, some of them delivered twice, with the poison in quarantine."""
    folder = scratch(t.spark, "ledger")
    m = X.messages(t)
    m.unionByName(m.filter("pos % 9 = 0")).select("value").repartition(4).write.text(f"{folder}/in")
    ledger = IdempotentLedger(t.spark, f"{folder}/state", f"{folder}/dead")
    ledger.run(f"{folder}/in", f"{folder}/checkpoint", 2)
    return ledger.balances()


@query(f"WITH {_STATE} SELECT key, k FROM la WHERE action = 'upsert'")
def stream_cdc(t: Tables) -> DataFrame:
    """The last state from a stream of envelopes that come in no order of their own, some of them twice."""
    folder = scratch(t.spark, "cdc")
    c = X.changes(t).select("op", "key", "pos", "k")
    append_jsonl(c.unionByName(c.filter("pos % 7 = 0")).repartition(4), f"{folder}/in")
    projection = Projection(t.spark, f"{folder}/state", ["k"])
    projection.run(f"{folder}/in", c.schema, f"{folder}/checkpoint", 2)
    return projection.state()
