"""Reconciliation, fingerprints, conservation and presence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, intervals, lifecycle, reconcile
from ..operators.metrics import conditional
from . import fixtures as X
from .fixtures import Tables
from .registry import query

_BOTH = f"{X.ORDERS}, {X.TARGET}"
FIELDS = ["status", "cents"]
_CLASSES = _BOTH + ", cl AS (SELECT coalesce(o.id, tg.id) AS id, CASE WHEN tg.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'orphan' WHEN o.status IS DISTINCT FROM tg.status OR o.cents IS DISTINCT FROM tg.cents THEN 'stale' END AS class FROM o FULL JOIN tg ON o.id = tg.id)"


@query(f"WITH {_CLASSES} SELECT id, class FROM cl WHERE class IS NOT NULL")
def reconcile_classes(t: Tables) -> DataFrame:
    return reconcile.classified(X.orders(t), X.target(t), "id", FIELDS)


@query(f"WITH {_BOTH} SELECT id, 'a' AS side FROM o ANTI JOIN tg USING (id) UNION ALL SELECT id, 'b' FROM tg ANTI JOIN o USING (id)")
def store_diff(t: Tables) -> DataFrame:
    return reconcile.store_diff(X.orders(t), X.target(t), "id")


@query(f"""WITH {_CLASSES}, bad AS (SELECT * FROM cl WHERE class IS NOT NULL),
fixed AS (SELECT id, status, cents FROM tg WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT id, status, cents FROM o WHERE id IN (SELECT id FROM bad WHERE class <> 'orphan'))
SELECT count(*) AS left_over FROM ((SELECT id, status, cents FROM o EXCEPT SELECT * FROM fixed) UNION ALL (SELECT * FROM fixed EXCEPT SELECT id, status, cents FROM o))""")
def repair_converges(t: Tables) -> DataFrame:
    """Differences after a repair."""
    source = X.orders(t)
    fixed = reconcile.repaired(source, X.target(t), "id", FIELDS)
    return reconcile.classified(source, fixed, "id", FIELDS).agg(F.count("*").alias("left_over"))


@query(f"WITH {_BOTH} SELECT count(*) AS n FROM o JOIN tg USING (id)")
def overlap_count(t: Tables) -> DataFrame:
    return X.orders(t).join(X.target(t), "id").agg(F.count("*").alias("n"))


@query(f"WITH {_BOTH} SELECT id, status FROM o SEMI JOIN tg USING (id)")
def exists_semi(t: Tables) -> DataFrame:
    return X.orders(t).join(X.target(t), "id", "left_semi").select("id", "status")


@query(f"WITH {_BOTH} SELECT id FROM o INTERSECT SELECT id FROM tg")
def acked_present(t: Tables) -> DataFrame:
    return X.orders(t).select("id").intersect(X.target(t).select("id"))


@query(f"""WITH {X.ORDERS}, e AS (SELECT customer, sum(cents)::BIGINT AS paid FROM o GROUP BY 1),
a AS (SELECT c_custkey AS customer, round(c_acctbal * 100)::BIGINT AS cents FROM customer)
SELECT a.customer, a.cents, coalesce(paid, 0) AS paid, a.cents - coalesce(paid, 0) AS drift
FROM a LEFT JOIN e USING (customer)""")
def ledger_audit(t: Tables) -> DataFrame:
    paid = X.orders(t).groupBy("customer").agg(F.sum("cents").cast("long").alias("paid"))
    a = t.customer.select(F.col("c_custkey").alias("customer"), S.cents(F.col("c_acctbal")).alias("cents"))
    return a.join(paid, "customer", "left").select("customer", "cents", F.coalesce("paid", F.lit(0)).alias("paid"), (F.col("cents") - F.coalesce("paid", F.lit(0))).alias("drift"))


_CACHE = """s AS (SELECT customer, sum(cents)::BIGINT AS cents FROM o GROUP BY 1),
ca AS (SELECT customer, cents + CASE WHEN customer % 41 = 0 THEN 7 WHEN customer % 43 = 0 THEN -9 ELSE 0 END AS cents FROM s)"""


def _cache(t: Tables) -> tuple[DataFrame, DataFrame]:
    sums = X.orders(t).groupBy("customer").agg(F.sum("cents").cast("long").alias("cents"))
    wrong = F.when(F.col("customer") % 41 == 0, 7).when(F.col("customer") % 43 == 0, -9).otherwise(0)
    return sums, sums.withColumn("cents", F.col("cents") + wrong)


@query(f"""WITH {X.ORDERS}, {_CACHE} SELECT customer, ca.cents AS cached, s.cents AS expected
FROM ca JOIN s USING (customer) WHERE ca.cents <> s.cents""")
def cache_drift(t: Tables) -> DataFrame:
    sums, cache = _cache(t)
    return cache.withColumnRenamed("cents", "cached").join(sums.withColumnRenamed("cents", "expected"), "customer").filter("cached <> expected")


@query(f"""WITH {X.ORDERS}, {_CACHE}, d AS (SELECT customer, ca.cents - s.cents AS drift FROM ca JOIN s USING (customer) WHERE ca.cents <> s.cents)
SELECT customer, drift, (SELECT sum(drift) FILTER (WHERE drift > 0) FROM d)::BIGINT AS over, (SELECT -sum(drift) FILTER (WHERE drift < 0) FROM d)::BIGINT AS lost, (SELECT count(*) FROM d) AS wrong
FROM d ORDER BY abs(drift) DESC, customer LIMIT 5""")
def drift_split(t: Tables) -> DataFrame:
    totals, drift = reconcile.drift_split(*_cache(t), "customer")
    worst = drift.orderBy(F.abs("drift").desc(), "customer").limit(5)
    return worst.join(F.broadcast(totals))


@query(f"WITH {X.ENTRIES} SELECT op, count(*) AS n FROM en GROUP BY 1 HAVING count(*) <> 2")
def pair_check(t: Tables) -> DataFrame:
    return X.entries(t).groupBy("op").agg(F.count("*").alias("n")).filter("n <> 2")


_STORES = """s AS (SELECT 'a' AS store, id, cents FROM o UNION ALL SELECT 'b', id, cents - CASE WHEN id = 5 THEN 100 ELSE 0 END FROM o UNION ALL SELECT 'c', id, CASE WHEN id = 7 THEN -1 WHEN id = 8 THEN cents + 1 + (SELECT cents FROM o WHERE id = 7) ELSE cents END FROM o)"""


@query(f"""WITH {X.ORDERS}, {_STORES} SELECT store, sum(cents)::BIGINT AS total, count(*) FILTER (WHERE cents < 0) AS negatives, sum(cents) = (SELECT sum(cents) FROM o) AND count(*) FILTER (WHERE cents < 0) = 0 AS ok
FROM s GROUP BY 1""")
def conservation(t: Tables) -> DataFrame:
    o = X.orders(t).select("id", "cents")
    totals = o.agg(F.sum("cents").alias("t"), F.max(F.when(F.col("id") == 7, F.col("cents"))).alias("c7")).first()
    short = o.withColumn("cents", F.col("cents") - F.when(F.col("id") == 5, 100).otherwise(0))
    negative = o.withColumn("cents", F.when(F.col("id") == 7, -1).when(F.col("id") == 8, F.col("cents") + 1 + totals.c7).otherwise(F.col("cents")))
    return reconcile.conservation({"a": o, "b": short, "c": negative}, totals.t)


@query("""WITH op AS (SELECT c_custkey AS account, 1000000::BIGINT AS cents FROM customer),
tr AS (SELECT o_custkey AS src, (o_custkey + 1) % (SELECT count(*) FROM customer) AS dst, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
mv AS (SELECT src AS account, -cents AS m FROM tr UNION ALL SELECT dst, cents FROM tr),
n AS (SELECT account, sum(m) AS net FROM mv GROUP BY 1) SELECT account, (cents + coalesce(net, 0))::BIGINT AS cents
FROM op LEFT JOIN n USING (account)""")
def implied_balance(t: Tables) -> DataFrame:
    n = t.customer.agg(F.count("*").alias("n"))
    opening = t.customer.select(F.col("c_custkey").alias("account"), F.lit(1_000_000).cast("long").alias("cents"))
    moves = t.orders.join(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") + 1) % F.col("n")).alias("dst"), S.cents(F.col("o_totalprice")).alias("cents"))
    return reconcile.implied_balance(opening, moves)


@query("""WITH l AS (SELECT c_custkey AS id FROM customer), a AS (SELECT id FROM l WHERE id % 5 = 0),
v AS (SELECT id FROM l WHERE id % 5 <> 0 AND id % 37 <> 0 OR id % 35 = 0),
j AS (SELECT l.id, v.id IS NOT NULL AS in_live, a.id IS NOT NULL AS in_archive FROM l LEFT JOIN v USING (id) LEFT JOIN a USING (id))
SELECT * FROM j WHERE in_live = in_archive""")
def xor_presence(t: Tables) -> DataFrame:
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    return reconcile.xor_presence(ids, ids.filter("id % 5 <> 0 AND id % 37 <> 0 OR id % 35 = 0"), ids.filter("id % 5 = 0"), "id")


_EXACT = "jr AS (SELECT id FROM o WHERE id % 59 <> 0), ap AS (SELECT id FROM o WHERE id % 61 <> 0 UNION ALL SELECT id FROM o WHERE id % 67 = 0)"


@query(f"""WITH {X.ORDERS}, {_EXACT}, x AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS journaled, coalesce(b.n, 0) AS applied FROM (SELECT id, count(*) AS n FROM jr GROUP BY 1) a FULL JOIN (SELECT id, count(*) AS n FROM ap GROUP BY 1) b ON a.id = b.id)
SELECT * FROM x WHERE journaled <> 1 OR applied <> 1""")
def exactly_once(t: Tables) -> DataFrame:
    ids = X.orders(t).select("id")
    return reconcile.exactly_once(ids.filter("id % 59 <> 0"), ids.filter("id % 61 <> 0").unionByName(ids.filter("id % 67 = 0")), "id")


@query(f"""WITH {_BOTH}, mi AS (SELECT id FROM o ANTI JOIN tg USING (id)),
sk AS (SELECT id FROM o WHERE id % 97 = 0 AND id % 2 = 0 UNION SELECT id FROM o WHERE id % 101 = 0)
SELECT coalesce(mi.id, sk.id) AS id, CASE WHEN sk.id IS NULL THEN 'expected' ELSE 'found' END AS only_in
FROM mi FULL JOIN sk ON mi.id = sk.id WHERE mi.id IS NULL OR sk.id IS NULL""")
def accounted_divergence(t: Tables) -> DataFrame:
    source = X.orders(t)
    missing = source.join(X.target(t), "id", "left_anti").select("id")
    skipped = source.filter("id % 97 = 0 AND id % 2 = 0 OR id % 101 = 0").select("id")
    return reconcile.unaccounted(missing, skipped, "id")


@query("""WITH ak AS (SELECT o_custkey AS ws, o_orderkey % 10 AS id, max(o_orderkey) AS acked FROM orders GROUP BY 1, 2),
st AS (SELECT ws, id, acked - CASE WHEN acked % 13 = 0 THEN 1 ELSE 0 END AS rev FROM ak WHERE acked % 17 <> 0)
SELECT ak.ws, ak.id, CASE WHEN rev IS NULL THEN 'missing' WHEN rev < acked THEN 'stale' ELSE 'ok' END AS outcome
FROM ak LEFT JOIN st USING (ws, id)""")
def acked_audit(t: Tables) -> DataFrame:
    acked = t.orders.select(F.col("o_custkey").alias("ws"), (F.col("o_orderkey") % 10).alias("id"), F.col("o_orderkey").alias("rev"))
    last = acked.groupBy("ws", "id").agg(F.max("rev").alias("rev"))
    stored = last.filter("rev % 17 <> 0").withColumn("rev", F.col("rev") - F.when(F.col("rev") % 13 == 0, 1).otherwise(0))
    return reconcile.acked_audit(acked, stored, ["ws", "id"], "rev")


@query(f"""WITH {X.ORDERS} SELECT id % 16 AS shard, count(*) AS n, sum(('0x' || substr(md5(concat_ws('#', id, customer, status, cents)), 1, 8))::BIGINT)::BIGINT AS print
FROM o GROUP BY 1""")
def partition_fingerprint(t: Tables) -> DataFrame:
    return reconcile.fingerprint(X.orders(t).withColumn("shard", F.col("id") % 16), ["shard"], ["id", "customer", "status", "cents"])


@query(f"""WITH {X.ORDERS} SELECT id // 1000 AS bucket, count(*) AS n, md5(string_agg(concat_ws('#', id, status, cents), ',' ORDER BY id)) AS checksum
FROM o GROUP BY 1""")
def range_checksum(t: Tables) -> DataFrame:
    return reconcile.range_checksum(X.orders(t), "id", 1000, ["id", "status", "cents"])


@query(f"""WITH {X.ORDERS}, {X.ACCOUNTS}, ch AS (SELECT customer, string_agg(concat_ws(':', id, status, cents), '|' ORDER BY id) AS x FROM o GROUP BY 1)
SELECT customer, substr(sha256(concat_ws('|', name, x)), 1, 16) AS digest
FROM c LEFT JOIN ch USING (customer)""")
def family_digest(t: Tables) -> DataFrame:
    line = F.concat_ws(":", F.col("id").cast("string"), "status", F.col("cents").cast("string"))
    return reconcile.family_digest(X.accounts(t), X.orders(t), "customer", F.col("name"), "id", line)


@query(f"SELECT c_custkey AS id, ({X.crc32_sql('c_custkey::VARCHAR')} % 4)::INT AS shard FROM customer")
def shard_crc(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), S.shard_crc(F.col("c_custkey"), 4).alias("shard"))


@query(f"""WITH {X.ORDERS}, x AS (SELECT ({X.crc32_sql("customer::VARCHAR")} % 4)::INT AS shard, concat_ws('#', id, customer, status, cents) AS line FROM o)
SELECT shard, count(*) AS n, sum({X.crc32_sql("line")})::BIGINT AS print FROM x GROUP BY 1""")
def crc_fingerprint(t: Tables) -> DataFrame:
    o = X.orders(t).withColumn("shard", S.shard_crc(F.col("customer"), 4))
    return reconcile.crc_fingerprint(o, ["shard"], ["id", "customer", "status", "cents"])


@query(f"WITH {X.STALENESS} SELECT pos, strategy, id, judged, stale, coalesce(staleness_ms, -1) AS staleness_ms FROM a")
def asof_staleness(t: Tables) -> DataFrame:
    reads, writes = X.staleness(t)
    audited = asof.stale_reads(reads.select("strategy", "id", "ts", "price", F.concat("source", F.lit("/"), F.col("pos").cast("string")).alias("source")), writes)
    return audited.select(F.split("source", "/")[1].cast("long").alias("pos"), "strategy", "id", "judged", "stale", F.coalesce("staleness_ms", F.lit(-1)).alias("staleness_ms"))


@query(f"""WITH {X.STALENESS}, st AS (SELECT strategy, staleness_ms AS v, row_number() OVER (PARTITION BY strategy ORDER BY staleness_ms) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM a WHERE stale)
SELECT strategy, count(*) AS reads, count(*) FILTER (WHERE judged) AS judged, round(100 * count(*) FILTER (WHERE source LIKE 'cache%') / count(*)::DOUBLE, 1) AS hit_rate, count(*) FILTER (WHERE stale) AS stale_count,
round(100 * count(*) FILTER (WHERE stale) / count(*) FILTER (WHERE judged)::DOUBLE, 2) AS stale_pct,
coalesce((SELECT v FROM st WHERE st.strategy = a.strategy AND i = least(n - 1, floor(0.5 * n))), 0) AS p50_ms, coalesce((SELECT v FROM st WHERE st.strategy = a.strategy AND i = least(n - 1, floor(0.99 * n))), 0) AS p99_ms,
coalesce(max(staleness_ms), 0) AS max_ms FROM a GROUP BY strategy""")
def staleness_summary(t: Tables) -> DataFrame:
    return asof.summary(asof.stale_reads(*X.staleness(t)))


@query(f"""WITH {X.STALENESS}, s AS (SELECT strategy, min(ts) AS t0 FROM a GROUP BY 1)
SELECT strategy, (ts - t0) // 86400000 AS bucket, count(*) AS reads, count(*) FILTER (WHERE stale) AS stale, coalesce(max(staleness_ms), 0) AS max_ms
FROM a JOIN s USING (strategy) GROUP BY 1, 2""")
def staleness_timeline(t: Tables) -> DataFrame:
    return asof.buckets(asof.stale_reads(*X.staleness(t)), 86_400_000)


@query(f"""WITH {X.EVENTS}, an AS (SELECT * FROM e WHERE kind IN ('error', 'signup'))
SELECT kind, count(*) AS n, (SELECT arg_max(ms, pos) - arg_min(ms, pos) FROM an) AS window_ms
FROM an GROUP BY 1""")
def error_window(t: Tables) -> DataFrame:
    """Anomalies by kind, and the time from the first to the last in file order."""
    an = X.events(t).filter("kind IN ('error', 'signup')")
    window = an.agg((F.max_by("ms", "pos") - F.min_by("ms", "pos")).alias("window_ms"))
    return an.groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(window))


_RPO = "WITH j AS (SELECT o_orderkey AS seq, o_orderkey % 11 <> 0 AS acked, o_orderkey % 29 <> 0 AS landed FROM orders)"


@query(f"""{_RPO} SELECT count(*) FILTER (WHERE acked) AS acked, count(*) FILTER (WHERE NOT acked) AS ambiguous, count(*) FILTER (WHERE acked AND NOT landed) AS lost, count(*) FILTER (WHERE NOT acked AND landed) AS landed, count(*) FILTER (WHERE NOT acked AND NOT landed) AS gone
FROM j""")
def rpo_report(t: Tables) -> DataFrame:
    j = t.orders.select((F.col("o_orderkey") % 11 != 0).alias("a"), (F.col("o_orderkey") % 29 != 0).alias("l"))
    one, a, landed = F.lit(1), F.col("a"), F.col("l")
    return j.agg(conditional(one, a).alias("acked"), conditional(one, ~a).alias("ambiguous"), conditional(one, a & ~landed).alias("lost"), conditional(one, ~a & landed).alias("landed"), conditional(one, ~a & ~landed).alias("gone"))


@query(f"""WITH {_BOTH}, x AS (SELECT o.id, o.status || '/' || o.cents AS served, tg.status || '/' || tg.cents AS shadow FROM o LEFT JOIN tg USING (id))
SELECT id FROM x WHERE served IS DISTINCT FROM shadow""")
def shadow_diff(t: Tables) -> DataFrame:
    from ..operators.events import shadow_diffs

    return shadow_diffs(X.orders(t), X.target(t), "id", FIELDS).select("id")


@query(f"""WITH {X.ORDERS} SELECT 'counts' AS gate, 0::BIGINT AS violations, true AS ok
UNION ALL SELECT 'misplaced', (SELECT count(*) FROM o WHERE id % 71 = 0 AND (id + 1) % 2 <> id % 2), false
UNION ALL SELECT 'diff', 0, true""")
def flip_gate(t: Tables) -> DataFrame:
    from ..operators.routing import misplaced

    o = X.orders(t)
    placed = o.withColumn("shard", F.when(F.col("id") % 71 == 0, (F.col("id") + 1) % 2).otherwise(F.col("id") % 2))
    checks = {"counts": o.agg(F.count("*").alias("n")).join(placed.agg(F.count("*").alias("n")), "n", "left_anti"), "misplaced": misplaced(placed, "shard", F.col("id") % 2), "diff": reconcile.classified(o, placed, "id", FIELDS)}
    return lifecycle.gate(checks)


@query(f"""WITH {_BOTH} SELECT count(*) AS violations, count(*) = 0 AS ok
FROM (SELECT id FROM o ANTI JOIN tg USING (id) UNION ALL SELECT id FROM tg ANTI JOIN o USING (id))""")
def cutover_gate(t: Tables) -> DataFrame:
    return lifecycle.gate({"stores": reconcile.store_diff(X.orders(t), X.target(t), "id")}).select("violations", "ok")


@query(f"""WITH {X.LEASES} SELECT a.worker, a.owner AS a, b.owner AS b, greatest(a.start_ms, b.start_ms) AS low, least(a.end_ms, b.end_ms) AS high
FROM se a JOIN se b ON a.worker = b.worker AND a.owner < b.owner AND greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms)""")
def lease_overlap(t: Tables) -> DataFrame:
    from ..operators.sequences import sessions

    return intervals.overlaps(sessions(X.leases(t), "worker", "pos"), "worker", 6 * 3_600_000)


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY event_id) AS idx, event_id // 7 * 2 + CASE WHEN event_id % 7 = 3 AND event_id % 5 = 0 THEN 2 ELSE 0 END AS session FROM events),
s AS (SELECT session, max(idx) - min(idx) + 1 - count(*) AS foreign_rows FROM l GROUP BY 1)
SELECT session, foreign_rows FROM s WHERE foreign_rows > 0""")
def critical_section(t: Tables) -> DataFrame:
    p = F.col("event_id")
    # Ids of the fixture run from 0 without gaps, so they are the ledger's index.
    ledger = t.events.select((p + 1).alias("idx"), (F.floor(p / 7) * 2 + F.when((p % 7 == 3) & (p % 5 == 0), 2).otherwise(0)).alias("session"))
    return intervals.interleaved(ledger, "session", "idx").withColumnRenamed("foreign", "foreign_rows")
