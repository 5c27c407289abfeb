"""Sequences, sessions, fencing, pages, interval sets, identifiers and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds, intervals, routing, sequences
from . import fixtures as X
from .fixtures import Tables
from .registry import query

_STREAM = f"{X.EVENTS}, i AS (SELECT key % 8 AS worker, pos, pos - CASE WHEN k % 9 = 0 THEN 40 ELSE 0 END AS id FROM e)"


def _ids(t: Tables) -> DataFrame:
    return X.events(t).select((F.col("key") % 8).alias("worker"), "pos", (F.col("pos") - F.when(F.col("k") % 9 == 0, 40).otherwise(0)).alias("id"))


@query(f"""WITH {_STREAM}, l AS (SELECT *, lag(id) OVER (PARTITION BY worker ORDER BY pos) AS before FROM i)
SELECT worker, pos, id, before FROM l WHERE id <= before""")
def monotonic_violations(t: Tables) -> DataFrame:
    return sequences.monotonic_violations(_ids(t), ["worker"], "id", "pos").select("worker", "pos", "id", "before")


@query(f"""WITH {_STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos)::INT AS sighting FROM i)
SELECT id, pos, sighting FROM r WHERE sighting > 1""")
def dup_ids(t: Tables) -> DataFrame:
    return sequences.repeats(_ids(t), "id", "pos").select("id", "pos", "sighting")


@query(f"""WITH {_STREAM}, r AS (SELECT worker, row_number() OVER (PARTITION BY worker ORDER BY pos) AS a, row_number() OVER (PARTITION BY worker ORDER BY id, pos) AS s FROM i)
SELECT worker, count(*) AS n, round(sum(abs(a - s))::DOUBLE / (count(*) * count(*)), 9) AS displacement
FROM r GROUP BY 1""")
def rank_displacement(t: Tables) -> DataFrame:
    placed = _ids(t).withColumn("sort_key", F.struct("id", "pos"))
    return sequences.rank_displacement(placed, "worker", "pos", "sort_key").withColumn("displacement", F.round("displacement", 9))


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders)
SELECT user_id, count(*) AS n, max(seq)::INT AS top FROM s WHERE o_orderkey % 13 <> 0
GROUP BY 1 HAVING count(*) <> max(seq)""")
def gap_check(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    numbered = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("o_orderkey")))
    return sequences.gaps(numbered.filter("o_orderkey % 13 <> 0"), "user_id", "seq")


@query(f"WITH {X.LEASES} SELECT worker, session, owner, start_ms, end_ms FROM se")
def lease_sessions(t: Tables) -> DataFrame:
    return sequences.sessions(X.leases(t), "worker", "pos").select("worker", "session", "owner", "start_ms", "end_ms")


_FENCED = f"""WITH {X.EVENTS}, f AS (SELECT key % 10 AS resource, pos, pos // 50 - k % 3 AS token FROM e),
m AS (SELECT *, max(token) OVER (PARTITION BY resource ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)"""


@query(f"{_FENCED} SELECT resource, pos, token, token >= coalesce(top, token) AS accepted FROM m")
def fencing_accept(t: Tables) -> DataFrame:
    attempts = X.events(t).select((F.col("key") % 10).alias("resource"), "pos", (F.floor(F.col("pos") / 50) - F.col("k") % 3).alias("token"))
    return sequences.fenced(attempts, "resource", "pos", "token")


@query(f"""{_FENCED} SELECT resource, count(*) FILTER (WHERE token >= coalesce(top, token)) AS accepted, count(*) FILTER (WHERE token < top) AS rejected
FROM m GROUP BY 1""")
def fencing_summary(t: Tables) -> DataFrame:
    return fencing_accept(t).groupBy("resource").agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected"))


@query(f"""WITH {X.ENTRIES} SELECT account, op, cents, row_number() OVER (PARTITION BY account ORDER BY op, cents)::INT AS seq, (sum(cents) OVER (PARTITION BY account ORDER BY op, cents ROWS UNBOUNDED PRECEDING))::BIGINT AS balance
FROM en""")
def ledger_running(t: Tables) -> DataFrame:
    return sequences.running_balance(X.entries(t), "account", ["op", "cents"], "cents").select("account", "op", "cents", "seq", "balance")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INT AS rn FROM orders QUALIFY rn <= 10")
def latest_n(t: Tables) -> DataFrame:
    return sequences.latest_n(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 10)


@query(f"""WITH {X.EVENTS}, f AS (SELECT kind AS name, min(ms) AS ts FROM e GROUP BY 1)
SELECT name, ts - (SELECT ts FROM f WHERE name = 'error') AS ms
FROM f""")
def rto_timeline(t: Tables) -> DataFrame:
    first = X.events(t).groupBy(F.col("kind").alias("name")).agg(F.min("ms").alias("ts"))
    return sequences.timeline(first, "error")


@query(f"""WITH {X.ORDERS}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 700 AS chunk FROM o WHERE id % 3 <> 0)
SELECT chunk, min(id) AS low, max(id) AS high, count(*) AS n FROM n
GROUP BY 1""")
def chunk_bounds(t: Tables) -> DataFrame:
    return sequences.chunk_bounds(X.orders(t).filter("id % 3 <> 0"), "id", 700)


@query(f"WITH {X.ORDERS} SELECT customer, id, cents FROM o WHERE (customer, id) > (300, 5000) ORDER BY customer, id LIMIT 500")
def keyset_page(t: Tables) -> DataFrame:
    page = X.orders(t).filter(sequences.after(F.col("customer"), F.col("id"), 300, 5000))
    return page.orderBy("customer", "id").limit(500).select("customer", "id", "cents")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000 AND o_orderkey % 10 < 3")
def range_chunk(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey >= 1000 AND o_orderkey < 2000 AND o_orderkey % 10 < 3").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'S%'")
def prefix_filter(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").startswith("S")).select("p_partkey")


_DRAW = "('0x' || substr(md5(concat_ws('#', {seed}, id)), 1, 8))::BIGINT"


@query(f"""WITH {X.ORDERS}, {X.TARGET}, s AS (SELECT * FROM o WHERE {_DRAW.format(seed=7)} % 1000000 < 200000)
SELECT s.id, CASE WHEN tg.id IS NULL THEN 'missing' ELSE 'stale' END AS class FROM s LEFT JOIN tg USING (id) WHERE tg.id IS NULL OR s.status IS DISTINCT FROM tg.status OR s.cents IS DISTINCT FROM tg.cents""")
def sample_compare(t: Tables) -> DataFrame:
    """A seeded sample of ids whose rows differ on the other side."""
    from ..operators.reconcile import classified

    sample = sequences.sampled(X.orders(t), "id", 7, 0.2)
    return classified(sample, X.target(t).join(sample.select("id"), "id", "left_semi"), "id", ["status", "cents"])


@query(f"WITH {X.ORDERS} SELECT id, customer FROM o ORDER BY {_DRAW.format(seed=11)}, id LIMIT 25")
def random_pick(t: Tables) -> DataFrame:
    return sequences.picked(X.orders(t).select("id", "customer"), "id", 11, 25)


# --- interval sets ---

_SETS = "b AS (SELECT o_custkey % 5 AS node, 'u' || o_custkey % 3 AS uuid, o_orderkey AS x FROM orders)"


def _sets(t: Tables) -> DataFrame:
    """(node, text): each node's transactions as uuid:lo-hi:..., cut into runs of ten."""
    k = F.col("o_orderkey")
    per = t.orders.select((F.col("o_custkey") % 5).alias("node"), F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string")).alias("uuid"), k)
    part = per.groupBy("node", "uuid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("o_orderkey")), lambda x: F.when(x % 2 == 0, F.concat(x.cast("string"), F.lit("-"), x.cast("string"))).otherwise(x.cast("string"))), ":").alias("r"))
    return part.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "uuid", "r"))), ",").alias("text"))


@query(f"WITH {_SETS} SELECT node, count(DISTINCT (uuid, x)) AS n FROM b GROUP BY 1")
def gtid_count(t: Tables) -> DataFrame:
    return intervals.set_size(intervals.parsed_sets(_sets(t), "text", "node"), "node")


@query(f"""WITH {_SETS}, d AS (SELECT DISTINCT uuid, x FROM b WHERE node IN (0, 1) EXCEPT SELECT uuid, x FROM b WHERE node IN (1, 2)),
g AS (SELECT uuid, x, x - row_number() OVER (PARTITION BY uuid ORDER BY x) AS g FROM d)
SELECT uuid, min(x) AS lo, max(x) AS hi FROM g GROUP BY uuid, g""")
def gtid_subtract(t: Tables) -> DataFrame:
    sets = intervals.parsed_sets(_sets(t), "text", "node")
    return intervals.subtracted(sets.filter("node IN (0, 1)"), sets.filter("node IN (1, 2)"))


@query(f"""WITH {_SETS}, d AS (SELECT DISTINCT uuid, x FROM b), g AS (SELECT uuid, x, x - row_number() OVER (PARTITION BY uuid ORDER BY x) AS g FROM d)
SELECT uuid, min(x) AS lo, max(x) AS hi FROM g GROUP BY uuid, g""")
def gtid_union(t: Tables) -> DataFrame:
    return intervals.merged_sets(intervals.parsed_sets(_sets(t), "text"))


@query("SELECT 9::BIGINT AS node, count(*) AS n FROM (SELECT DISTINCT o_custkey % 3 AS u, o_orderkey FROM orders)")
def gtid_candidate(t: Tables) -> DataFrame:
    """Of all nodes and one more that holds everything, the one that holds everything."""
    sets = intervals.parsed_sets(_sets(t), "text", "node")
    whole = sets.withColumn("node", F.lit(9).cast("long"))
    return intervals.largest_set(sets.unionByName(whole), "node")


# --- identifiers ---

_PACK = f"WITH {X.EVENTS} SELECT pos, (((ms - {S.EPOCH_MS}) & 2199023255551) << 22) | ((key % 1024) << 12) | (pos & 4095) AS id FROM e"


def _packed(t: Tables) -> DataFrame:
    return X.events(t).select("pos", S.packed_id((F.col("ms") - S.EPOCH_MS).bitwiseAND(F.lit((1 << 41) - 1)), F.col("key") % 1024, F.col("pos").bitwiseAND(F.lit(S.MAX_SEQ))).alias("id"))


@query(_PACK)
def id_encode(t: Tables) -> DataFrame:
    return _packed(t)


@query(f"SELECT pos, id >> 22 AS ts_ms, (id >> 12) & 1023 AS worker, id & 4095 AS seq FROM ({_PACK})")
def id_decode(t: Tables) -> DataFrame:
    return _packed(t).select("pos", *[c.alias(n) for n, c in S.unpacked_id(F.col("id")).items()])


_ISSUED = f"""{X.CLOCK}, rn AS (SELECT *, CASE WHEN ts = lag(ts) OVER (PARTITION BY worker ORDER BY pos) THEN 0 ELSE 1 END AS new, max(ts) OVER (PARTITION BY worker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ck)"""


@query(f"""WITH {_ISSUED}, gr AS (SELECT worker, pos, ts, sum(new) OVER (PARTITION BY worker ORDER BY pos) AS run FROM rn),
sq AS (SELECT worker, ts, (row_number() OVER (PARTITION BY worker, run ORDER BY pos) - 1) & 4095 AS seq FROM gr)
SELECT worker, count(*) AS ids, count(*) - count(DISTINCT (ts << 22) | (worker << 12) | seq) AS duplicates FROM sq GROUP BY 1""")
def id_naive(t: Tables) -> DataFrame:
    issued = folds.generated_ids(X.clock(t), "worker", "naive")
    return issued.groupBy("worker").agg(F.count("*").alias("ids"), (F.count("*") - F.count_distinct("id")).alias("duplicates"))


@query(f"""WITH {_ISSUED}, st AS (SELECT *, sum(CASE WHEN ts < top THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY pos) AS behind FROM rn),
g AS (SELECT 'error' AS policy, worker, pos, ts FROM st WHERE behind = 0 UNION ALL SELECT 'wait', worker, pos, ts FROM st WHERE ts >= coalesce(top, ts) UNION ALL SELECT 'hold', worker, pos, greatest(ts, top) FROM st),
sq AS (SELECT *, row_number() OVER (PARTITION BY policy, worker, ts ORDER BY pos) - 1 AS seq FROM g)
SELECT worker, count(*) AS ids, count(*) - count(DISTINCT (ts << 22) | (worker << 12) | seq) AS duplicates, policy FROM sq GROUP BY worker, policy""")
def id_policies(t: Tables) -> DataFrame:
    parts = [folds.generated_ids(X.clock(t), "worker", p).groupBy("worker").agg(F.count("*").alias("ids"), (F.count("*") - F.count_distinct("id")).alias("duplicates")).withColumn("policy", F.lit(p)) for p in ("error", "wait", "hold")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def id_uuid7(t: Tables) -> DataFrame:
    return X.events(t).select("pos", S.uuid7(F.col("ms")).alias("id"))


@query("SELECT o_orderkey AS old_id, 20001 + 2 * (o_orderkey // 2) - o_orderkey % 2 + 1 AS id FROM orders")
def interleave_ids(t: Tables) -> DataFrame:
    """Two writers by parity from 20001 on: the even one starts at 20002."""
    from ..operators.lifecycle import interleaved_ids

    k = F.col("o_orderkey")
    even, odd = interleaved_ids(F.floor(k / 2), 20_001, 0), interleaved_ids(F.floor(k / 2), 20_001, 1)
    return t.orders.select(k.alias("old_id"), F.when(k % 2 == 0, even).otherwise(odd).alias("id"))


# --- routing ---

_MODES = "CASE pos % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'double-write' WHEN 2 THEN 'shadow-read' ELSE 'sharded' END"


@query(f"""WITH {X.EVENTS}, op AS (SELECT pos, CASE WHEN kind = 'click' THEN 'read' ELSE 'write' END AS op, {_MODES} AS mode, 'shard' || key % 4 AS shard FROM e)
SELECT pos, op, mode, CASE WHEN mode = 'sharded' THEN shard ELSE 'mono' END AS node, 'authoritative' AS leg FROM op
UNION ALL SELECT pos, op, mode, CASE WHEN mode = 'sharded' THEN 'mono' ELSE shard END, CASE WHEN op = 'read' THEN 'shadow' ELSE 'best-effort' END FROM op WHERE CASE WHEN op = 'read' THEN mode = 'shadow-read' ELSE mode <> 'single' END""")
def route_ops(t: Tables) -> DataFrame:
    p = F.col("pos") % 4
    mode = F.when(p == 0, "single").when(p == 1, "double-write").when(p == 2, "shadow-read").otherwise("sharded")
    ops = X.events(t).select("pos", F.when(F.col("kind") == "click", "read").otherwise("write").alias("op"), mode.alias("mode"), routing.shard_name(F.col("key") % 4).alias("shard"))
    return routing.routed(ops, F.col("mode"), F.col("shard")).drop("shard")


@query(f"""WITH {X.ORDERS}, p AS (SELECT id, CASE WHEN id % 71 = 0 THEN (id + 1) % 4 ELSE id % 4 END AS shard FROM o)
SELECT id, shard FROM p WHERE shard <> id % 4""")
def misplaced_rows(t: Tables) -> DataFrame:
    placed = X.orders(t).select("id", F.when(F.col("id") % 71 == 0, (F.col("id") + 1) % 4).otherwise(F.col("id") % 4).alias("shard"))
    return routing.misplaced(placed, "shard", F.col("id") % 4)


@query(f"WITH {X.ORDERS} SELECT id, (id % 2)::INT AS shard, status FROM o")
def shard_split(t: Tables) -> DataFrame:
    o = X.orders(t).select("id", S.shard_modulo(F.col("id"), 2).alias("shard"), "status")
    return o.filter("shard = 0").unionByName(o.filter("shard = 1"))


@query(f"""WITH {X.ORDERS}, {X.TARGET} SELECT (SELECT count(*) FROM tg) AS shards, (SELECT count(*) FROM o) AS reference, (SELECT count(*) FROM tg) = (SELECT count(*) FROM o) AS ok""")
def shard_counts(t: Tables) -> DataFrame:
    return routing.shard_counts(X.target(t), "priority", X.orders(t))


@query(f"""WITH {X.EVENTS}, g AS (SELECT unnest([{{'low': 100, 'high': 180}}, {{'low': 5000, 'high': 5200}}], recursive := true))
SELECT pos, coalesce(high, pos) AS released_at FROM e LEFT JOIN g ON pos >= low AND pos < high""")
def write_gate(t: Tables) -> DataFrame:
    gates = t.spark.createDataFrame([(100, 180), (5000, 5200)], "low long, high long")
    return routing.gated(X.events(t).select("pos"), gates, "pos")
