"""Sides that the audits compare, derived from the driver's tables by fixed formulas; the same formulas as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cents, epoch_ms

T0 = 1_700_000_000_000


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def orders(t: Tables) -> DataFrame:
    """id, customer, status, cents, priority."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), cents(F.col("o_totalprice")).alias("cents"), F.col("o_orderpriority").alias("priority"))


ORDERS = """o AS (SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS cents, o_orderpriority AS priority FROM orders)"""


def target(t: Tables) -> DataFrame:
    """orders with every 97th missing, every 89th stale, and orphans made of every 83rd."""
    o = orders(t)
    kept = o.filter("id % 97 <> 0").withColumn("status", F.when(F.col("id") % 89 == 0, "X").otherwise(F.col("status")))
    return kept.unionByName(o.filter("id % 83 = 0").withColumn("id", F.col("id") + 1_000_000_000))


TARGET = """tg AS (SELECT id, customer, CASE WHEN id % 89 = 0 THEN 'X' ELSE status END AS status, cents, priority FROM o WHERE id % 97 <> 0
  UNION ALL SELECT id + 1000000000, customer, status, cents, priority FROM o WHERE id % 83 = 0)"""


def events(t: Tables) -> DataFrame:
    """pos, key, ms, kind, value, k (the number in props)."""
    return t.events.select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"), epoch_ms("ts").alias("ms"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS = """e AS (SELECT event_id AS pos, user_id AS key, epoch_us(ts) // 1000 AS ms, event_type AS kind, value, json_extract_string(props, '$.k')::INT AS k FROM events)"""


def minutes(t: Tables, minutes: int = 60) -> DataFrame:
    """events with the minute of 60 that each falls into by its place."""
    e = events(t)
    n = e.agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n)).withColumn("minute", F.least(F.expr(f"pos * {minutes} div n"), F.lit(minutes - 1).cast("long"))).drop("n")


MINUTES = EVENTS + ", m AS (SELECT e.*, least(pos * 60 // (SELECT count(*) FROM e), 59) AS minute FROM e)"


def changes(t: Tables) -> DataFrame:
    """pos, key, op, value: envelopes."""
    op = F.when(F.col("kind") == "signup", "c").when(F.col("kind") == "click", "u").when(F.col("kind") == "error", "d").otherwise("r")
    return events(t).select("pos", "key", "ms", F.when(F.col("pos") % 101 == 0, F.lit(None)).when(F.col("pos") % 103 == 0, "t").otherwise(op).alias("op"), "k")


CHANGES = EVENTS + """, ch AS (SELECT pos, key, ms, CASE WHEN pos % 101 = 0 THEN NULL WHEN pos % 103 = 0 THEN 't' WHEN kind = 'signup' THEN 'c' WHEN kind = 'click' THEN 'u'
  WHEN kind = 'error' THEN 'd' ELSE 'r' END AS op, k FROM e)"""


def deliveries(t: Tables) -> DataFrame:
    """orders, and every 20th once more: (pos, id, customer, cents)."""
    o = orders(t).select("id", "customer", "cents")
    return o.withColumn("pos", F.col("id")).unionByName(o.filter("id % 20 = 0").withColumn("pos", F.col("id") + 10_000_000_000))


DELIVERIES = ORDERS + ", d AS (SELECT id AS pos, id, customer, cents FROM o UNION ALL SELECT id + 10000000000, id, customer, cents FROM o WHERE id % 20 = 0)"


def messages(t: Tables) -> DataFrame:
    """pos and value: a JSON message for each event, some of them poison."""
    e = events(t)
    p = F.col("pos")
    amount = F.when(p % 50 == 0, F.concat(F.lit('"'), "k", F.lit('"'))).when(p % 53 == 0, F.lit("true")).when(p % 59 == 0, F.lit("5.5")).otherwise(F.col("k").cast("string"))
    body = F.concat(F.lit('{"event_id":"e'), p.cast("string"), F.lit('","account_id":'), F.col("key").cast("string"), F.when(p % 61 == 0, "").otherwise(F.concat(F.lit(',"amount":'), amount)), F.lit("}"))
    return e.select("pos", "key", "k", F.when(p % 67 == 0, "not json").otherwise(body).alias("value"))


POISON = "(pos % 50 = 0 OR pos % 53 = 0 OR pos % 59 = 0 OR pos % 61 = 0 OR pos % 67 = 0)"


def staleness(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(reads, writes): purchases write a price, clicks were served one of an earlier event."""
    e = events(t)
    price = F.pmod("k", F.lit(5)).cast("double")
    id_ = F.pmod("key", F.lit(40)).alias("id")
    strategy = F.when(F.pmod("key", F.lit(2)) == 0, "ttl").otherwise("cdc").alias("strategy")
    writes = e.filter("kind = 'purchase'").groupBy(strategy, id_, F.col("ms").alias("ts")).agg(F.max(price).alias("price"))
    reads = e.filter("kind = 'click'").select("pos", strategy, id_, F.col("ms").alias("ts"), price.alias("price"), F.when(F.col("k") % 3 == 0, "db").otherwise("cache").alias("source"))
    return reads, writes


STALENESS = EVENTS + """, wr AS (SELECT CASE WHEN key % 2 = 0 THEN 'ttl' ELSE 'cdc' END AS strategy, key % 40 AS id, ms AS ts, max(k % 5)::DOUBLE AS price FROM e WHERE kind = 'purchase' GROUP BY ALL),
rd AS (SELECT pos, CASE WHEN key % 2 = 0 THEN 'ttl' ELSE 'cdc' END AS strategy, key % 40 AS id, ms AS ts, (k % 5)::DOUBLE AS price, CASE WHEN k % 3 = 0 THEN 'db' ELSE 'cache' END AS source FROM e WHERE kind = 'click'),
h AS (SELECT *, lead(ts) OVER (PARTITION BY strategy, id ORDER BY ts, price) AS next_ts, min(ts) OVER (PARTITION BY strategy, id) AS first_ts FROM wr),
j AS (SELECT rd.*, (SELECT max_by(h.price, h.ts) FROM h WHERE h.strategy = rd.strategy AND h.id = rd.id AND h.ts <= rd.ts + 100) AS truth,
  (SELECT max_by(h.ts, h.ts) FROM h WHERE h.strategy = rd.strategy AND h.id = rd.id AND h.ts <= rd.ts AND h.price = rd.price) AS origin,
  (SELECT min(h.ts) FROM h WHERE h.strategy = rd.strategy AND h.id = rd.id) AS first_ts FROM rd),
a AS (SELECT j.pos, j.strategy, j.id, j.ts, j.source, j.price, truth IS NOT NULL AS judged, coalesce(truth <> j.price, false) AS stale,
  CASE WHEN truth <> j.price THEN greatest(0, j.ts - CASE WHEN origin IS NULL THEN j.first_ts ELSE coalesce(h.next_ts, j.ts) END) END AS staleness_ms
  FROM j LEFT JOIN h ON h.strategy = j.strategy AND h.id = j.id AND h.ts = j.origin)"""


def entries(t: Tables) -> DataFrame:
    """(op, account, cents): a debit and a credit for each order; every 50th lacks its credit, every 71st has it twice."""
    o = orders(t)
    debit = o.select(F.col("id").alias("op"), F.col("customer").alias("account"), (-F.col("cents")).alias("cents"))
    credit = o.filter("id % 50 <> 0").select(F.col("id").alias("op"), (F.col("customer") + 1).alias("account"), "cents")
    return debit.unionByName(credit).unionByName(credit.filter("op % 71 = 0"))


ENTRIES = ORDERS + """, en AS (SELECT id AS op, customer AS account, -cents AS cents FROM o UNION ALL SELECT id, customer + 1, cents FROM o WHERE id % 50 <> 0
  UNION ALL SELECT id, customer + 1, cents FROM o WHERE id % 50 <> 0 AND id % 71 = 0)"""


def leases(t: Tables) -> DataFrame:
    """(worker, pos, owner, event, at, expires_at): a log of claims, renewals and releases."""
    e = events(t).filter("pos % 3 = 0")
    kind = F.when(F.col("kind") == "signup", "claim").when(F.col("kind") == "error", "release").otherwise("renew")
    return e.select(F.pmod("key", F.lit(20)).alias("worker"), "pos", F.col("key").alias("owner"), kind.alias("event"), F.col("ms").alias("at"), (F.col("ms") + 600_000 + F.col("k") * 1000).alias("expires_at"))


LEASES = EVENTS + """, ls AS (SELECT key % 20 AS worker, pos, key AS owner, CASE WHEN kind = 'signup' THEN 'claim' WHEN kind = 'error' THEN 'release' ELSE 'renew' END AS event,
  ms AS t, ms + 600000 + k * 1000 AS expires_at FROM e WHERE pos % 3 = 0),
lm AS (SELECT *, sum(CASE WHEN event = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY pos) AS session FROM ls),
se AS (SELECT worker, session::BIGINT AS session, arg_min(owner, pos) AS owner, min(t) AS start_ms,
  least(max(expires_at) FILTER (WHERE event <> 'release'), coalesce(min(t) FILTER (WHERE event = 'release'), max(expires_at) FILTER (WHERE event <> 'release'))) AS end_ms
  FROM lm WHERE session > 0 GROUP BY worker, session)"""


def items(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(items, reservations): parts with a capacity, and an order line as a reservation of its part."""
    r = t.lineitem.filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("reservation_id")).agg(F.min("l_partkey").alias("item_id"), F.max(cents(F.col("l_extendedprice"))).alias("c"))
    state = F.when(F.pmod("c", F.lit(5)) == 0, "committed").when(F.pmod("c", F.lit(5)) == 1, "expired").otherwise("active")
    r = r.select("reservation_id", "item_id", state.alias("state"), (F.lit(T0) + F.pmod("c", F.lit(1000)) * 1000).alias("expires_at"))
    n = r.groupBy("item_id").agg(F.count(F.when(F.col("state") == "active", 1)).alias("a"), F.count(F.when(F.col("state") == "committed", 1)).alias("s"))
    i = t.part.select(F.col("p_partkey").alias("item_id"), F.pmod("p_size", F.lit(7)).cast("long").alias("capacity")).join(n, "item_id", "left")
    return i.select("item_id", "capacity", F.coalesce("a", F.lit(0)).alias("reserved"), F.coalesce("s", F.lit(0)).alias("sold")), r


ITEMS = f"""r0 AS (SELECT l_orderkey AS reservation_id, min(l_partkey) AS item_id, max(round(l_extendedprice * 100)::BIGINT) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
r AS (SELECT reservation_id, item_id, CASE WHEN c % 5 = 0 THEN 'committed' WHEN c % 5 = 1 THEN 'expired' ELSE 'active' END AS state, {T0} + c % 1000 * 1000 AS expires_at FROM r0),
i AS (SELECT p_partkey AS item_id, (p_size % 7)::BIGINT AS capacity, (SELECT count(*) FROM r WHERE r.item_id = p_partkey AND state = 'active') AS reserved,
  (SELECT count(*) FROM r WHERE r.item_id = p_partkey AND state = 'committed') AS sold FROM part)"""


def accounts(t: Tables) -> DataFrame:
    """(account, deleted_at): customers, every 7th deleted."""
    return t.customer.select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.lit(T0) + F.col("c_custkey") * 1000).alias("deleted_at"))


ACCOUNTS = f"""c AS (SELECT c_custkey AS customer, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN {T0} + c_custkey * 1000 END AS deleted_at FROM customer)"""


def names(t: Tables) -> DataFrame:
    """(id, name, first_name, last_name): names with spaces, some already split, some split wrongly."""
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.replace("c_name", F.lit("#"), F.lit(""))).when(k % 10 == 1, F.concat(F.lit(" "), "c_name")).when(k % 10 == 2, F.concat("c_name", F.lit("  x y"))).when(k % 10 == 3, F.concat("c_name", F.lit(" "))).otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" "), "c_mktsegment"))
    return t.customer.select(k.alias("id"), F.when(k % 31 != 0, name).alias("name"), F.when(k % 4 == 0, "Wrong").when(k % 4 == 1, "").alias("first_name"), F.when(k % 3 == 0, "Off").alias("last_name"))


NAMES = """nm AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 31 <> 0 THEN CASE c_custkey % 10 WHEN 0 THEN replace(c_name, '#', '') WHEN 1 THEN ' ' || c_name WHEN 2 THEN c_name || '  x y' WHEN 3 THEN c_name || ' '
  ELSE replace(c_name, '#', ' ') || ' ' || c_mktsegment END END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'Wrong' WHEN 1 THEN '' END AS first_name, CASE WHEN c_custkey % 3 = 0 THEN 'Off' END AS last_name FROM customer),
sp AS (SELECT *, CASE WHEN contains(name, ' ') THEN left(name, length(name) - length(split_part(name, ' ', -1)) - 1) ELSE name END AS f,
  CASE WHEN contains(name, ' ') THEN split_part(name, ' ', -1) WHEN name IS NOT NULL THEN '' END AS l FROM nm)"""


def clock(t: Tables) -> DataFrame:
    """(worker, pos, ts): readings of three clocks that stand still, run and now and then go back."""
    p = F.col("pos")
    return events(t).select(F.pmod(p, F.lit(3)).alias("worker"), F.floor(p / 3).alias("pos"), (F.lit(100) + F.floor(p / 12) - F.when(F.pmod(p, F.lit(300)) > 285, 5).otherwise(0)).alias("ts"))


CLOCK = EVENTS + """, ck AS (SELECT pos % 3 AS worker, pos // 3 AS pos, 100 + pos // 12 - CASE WHEN pos % 300 > 285 THEN 5 ELSE 0 END AS ts FROM e)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, a bit at a time."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
