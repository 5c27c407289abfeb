"""Merges, moves, archives, schema changes, reservations and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds, lifecycle, reconcile
from . import fixtures as X
from .fixtures import T0, Tables
from .registry import query

_OLD_NEW = f"""{X.ORDERS}, ol AS (SELECT id, status, cents FROM o WHERE id % 3 <> 0),
nw AS (SELECT id, 'N' AS status, cents + 1 AS cents FROM o WHERE id % 5 = 0)"""


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = X.orders(t)
    return o.filter("id % 3 <> 0").select("id", "status", "cents"), o.filter("id % 5 = 0").select("id", F.lit("N").alias("status"), (F.col("cents") + 1).alias("cents"))


@query(f"WITH {_OLD_NEW} SELECT * FROM ol ANTI JOIN nw USING (id) UNION ALL SELECT * FROM nw")
def upsert_merge(t: Tables) -> DataFrame:
    return lifecycle.upserted(*_old_new(t), "id")


@query(f"WITH {_OLD_NEW} SELECT * FROM ol UNION ALL SELECT * FROM nw ANTI JOIN ol USING (id)")
def insert_ignore(t: Tables) -> DataFrame:
    return lifecycle.insert_ignored(*_old_new(t), "id")


@query(f"WITH {_OLD_NEW} SELECT * FROM ol ANTI JOIN nw USING (id) UNION ALL SELECT * FROM nw")
def replace_merge(t: Tables) -> DataFrame:
    return lifecycle.replaced(*_old_new(t), "id")


@query(f"""WITH {_OLD_NEW}, lg AS (SELECT id % 4000 AS id, status, cents, id AS pos, id % 7 = 0 AS gone FROM o), la AS (SELECT id, arg_max(status, pos) AS status, arg_max(cents, pos) AS cents, arg_max(gone, pos) AS gone FROM lg GROUP BY 1)
SELECT * FROM ol ANTI JOIN la USING (id) UNION ALL SELECT id, status, cents FROM la WHERE NOT gone""")
def backfill_vs_log(t: Tables) -> DataFrame:
    old, _ = _old_new(t)
    o = X.orders(t)
    log = o.select((F.col("id") % 4000).alias("id"), "status", "cents", F.col("id").alias("pos"))
    return lifecycle.backfilled(old, log, "id", "pos", F.col("pos") % 7 == 0)


@query(f"WITH {X.ACCOUNTS} SELECT customer, name FROM c WHERE deleted_at IS NULL")
def softdel_live(t: Tables) -> DataFrame:
    return lifecycle.live(X.accounts(t)).select("customer", "name")


_CHILDREN = f"{X.ORDERS}, {X.ACCOUNTS}, ch AS (SELECT id, customer, CASE WHEN id % 11 = 0 THEN 1 END AS deleted_at FROM o)"


def _children(t: Tables) -> DataFrame:
    return X.orders(t).select("id", "customer", F.when(F.col("id") % 11 == 0, F.lit(1).cast("long")).alias("deleted_at"))


@query(f"""WITH {_CHILDREN} SELECT id, customer, coalesce(deleted_at, CASE WHEN customer % 13 = 0 AND customer IN (SELECT customer FROM c) THEN {T0} END, -1)::BIGINT AS deleted_at
FROM ch""")
def cascade_flag(t: Tables) -> DataFrame:
    _, down = lifecycle.cascade_flagged(X.accounts(t), _children(t), "customer", F.col("customer") % 13 == 0, T0)
    return down.select("id", "customer", F.coalesce("deleted_at", F.lit(-1)).alias("deleted_at"))


@query(f"WITH {_CHILDREN} SELECT customer FROM c ANTI JOIN (SELECT * FROM o WHERE id % 5 = 0) x USING (customer)")
def parent_guard(t: Tables) -> DataFrame:
    return lifecycle.parents_without(X.accounts(t), X.orders(t).filter("id % 5 = 0"), "customer").select("customer")


@query(f"""WITH {_CHILDREN} SELECT 'live' AS side, id, customer, -1::BIGINT AS _moved_at, '' AS _reason
FROM o WHERE customer % 13 <> 0 OR customer NOT IN (SELECT customer FROM c)
UNION ALL SELECT 'mirror', id, customer, {T0}, 'request' FROM o
WHERE customer % 13 = 0 AND customer IN (SELECT customer FROM c)""")
def mirror_move(t: Tables) -> DataFrame:
    keys = X.accounts(t).filter("customer % 13 = 0").select("customer")
    stay, gone = lifecycle.moved(X.orders(t).select("id", "customer"), keys, "customer", T0, "request")
    return lifecycle.aligned_union(stay.withColumn("side", F.lit("live")), gone.withColumn("side", F.lit("mirror"))).na.fill(-1, ["_moved_at"]).na.fill("", ["_reason"])


@query(f"""WITH {_CHILDREN}, ks AS (SELECT customer FROM c WHERE customer % 13 = 0), stay AS (SELECT * FROM o ANTI JOIN ks USING (customer)), gone AS (SELECT *, {T0} AS _moved_at FROM o SEMI JOIN ks USING (customer)),
back AS (SELECT * FROM stay UNION ALL SELECT id, customer, status, cents, priority FROM gone)
SELECT count(*) AS changed FROM ((SELECT * FROM back EXCEPT ALL SELECT * FROM o) UNION ALL (SELECT * FROM o EXCEPT ALL SELECT * FROM back))""")
def mirror_roundtrip(t: Tables) -> DataFrame:
    """Rows that differ after a move to the mirror and back."""
    o = X.orders(t)
    keys = X.accounts(t).filter("customer % 13 = 0").select("customer")
    stay, gone = lifecycle.moved(o, keys, "customer", T0, "request")
    back, _ = lifecycle.restored(stay, gone, keys, "customer")
    return back.exceptAll(o).unionByName(o.exceptAll(back)).agg(F.count("*").alias("changed"))


@query(f"""WITH {X.ACCOUNTS}, cut AS (SELECT customer FROM c WHERE deleted_at IS NOT NULL ORDER BY customer LIMIT 50)
SELECT customer, customer IN (SELECT customer FROM cut) AS archived
FROM c""")
def archive_split(t: Tables) -> DataFrame:
    left, gone = lifecycle.archived(X.accounts(t), F.col("deleted_at").isNotNull(), T0, 50, "customer")
    return left.select("customer", F.lit(False).alias("archived")).unionByName(gone.select("customer", F.lit(True).alias("archived")))


@query(f"WITH {X.ACCOUNTS} SELECT customer FROM c WHERE deleted_at >= {T0} + 1000000 - 600000")
def purge_retention(t: Tables) -> DataFrame:
    archive = X.accounts(t).filter("deleted_at IS NOT NULL").withColumnRenamed("deleted_at", "_archived_at")
    return lifecycle.purged(archive, T0 + 1_000_000, 600_000).select("customer")


@query(f"WITH {X.ACCOUNTS} SELECT customer, CASE WHEN deleted_at IS NOT NULL THEN name || '#deleted#' || customer ELSE name END AS name FROM c")
def tombstone_email(t: Tables) -> DataFrame:
    return X.accounts(t).select("customer", lifecycle.tombstoned(F.col("name"), F.col("customer"), F.col("deleted_at").isNotNull()).alias("name"))


@query("SELECT 'c_acctbal' AS column_name, 'type' AS only_in UNION ALL SELECT 'c_phone', 'b' UNION ALL SELECT 'c_mktsegment', 'a'")
def schema_drift(t: Tables) -> DataFrame:
    a = t.customer
    b = a.drop("c_mktsegment").withColumn("c_phone", F.lit(None).cast("string")).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    return lifecycle.schema_drift(a, b)


@query("SELECT c_custkey, c_name FROM customer")
def schema_shared(t: Tables) -> DataFrame:
    target = t.spark.createDataFrame([], "c_name string, extra int, c_custkey long")
    return t.customer.select(*lifecycle.shared_columns(t.customer, target))


@query("SELECT c_custkey, NULL::VARCHAR AS first_name, NULL::VARCHAR AS last_name FROM customer")
def schema_evolve(t: Tables) -> DataFrame:
    return lifecycle.expanded(t.customer.select("c_custkey"), {"first_name": "string", "last_name": "string"})


@query("SELECT o_orderkey, o_totalprice::DECIMAL(12,2)::DOUBLE AS amount, 'USD' AS currency FROM orders")
def type_migrate(t: Tables) -> DataFrame:
    migrated = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.lit("USD").alias("currency"))
    return migrated.withColumn("amount", F.col("amount").cast("double"))


@query(f"WITH {X.NAMES} SELECT id, f AS first_name, l AS last_name FROM sp")
def name_split(t: Tables) -> DataFrame:
    return X.names(t).select("id", S.name_first(F.col("name")).alias("first_name"), S.name_last(F.col("name")).alias("last_name"))


@query(f"""WITH {X.NAMES} SELECT id, CASE WHEN first_name IS NULL AND last_name IS NULL THEN NULL ELSE concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) END AS name
FROM nm""")
def name_compose(t: Tables) -> DataFrame:
    return X.names(t).select("id", S.name_composed(F.col("first_name"), F.col("last_name")).alias("name"))


_FIX = "coalesce(first_name IS NULL OR first_name <> f OR last_name <> l, false) AND name IS NOT NULL"


@query(f"WITH {X.NAMES} SELECT id FROM sp WHERE {_FIX}")
def shape_disagree(t: Tables) -> DataFrame:
    return X.names(t).filter(lifecycle.needs_fix()).select("id")


@query(f"""WITH {X.NAMES} SELECT id, CASE WHEN {_FIX} THEN f ELSE first_name END AS first_name, CASE WHEN {_FIX} THEN l ELSE last_name END AS last_name
FROM sp""")
def name_backfill(t: Tables) -> DataFrame:
    return lifecycle.converged(X.names(t)).select("id", "first_name", "last_name")


@query(f"""WITH {X.NAMES} SELECT 'agree' AS gate, 0::BIGINT AS violations, true AS ok
UNION ALL SELECT 'before', count(*), count(*) = 0 FROM sp WHERE {_FIX}
UNION ALL SELECT 'composable', 0, true""")
def contract_gate(t: Tables) -> DataFrame:
    """Whether the old column may go: nothing to fix after the backfill, and the name comes back from its parts."""
    done = lifecycle.converged(X.names(t))
    back = S.name_composed(F.col("first_name"), F.col("last_name"))
    regular = done.filter("name = regexp_replace(trim(name), ' +', ' ')").filter(~lifecycle.needs_fix()).filter("coalesce(last_name, '') = substring_index(name, ' ', -1) OR instr(name, ' ') = 0")
    wrong = regular.filter(~back.eqNullSafe(F.col("name")) & F.col("last_name").isNotNull())
    return lifecycle.gate({"before": X.names(t).filter(lifecycle.needs_fix()), "agree": done.filter(lifecycle.needs_fix()), "composable": wrong})


@query(f"WITH {X.ITEMS} SELECT reservation_id, state FROM r WHERE state = 'active' AND expires_at < {T0 + 400_000}")
def ttl_overdue(t: Tables) -> DataFrame:
    _, r = X.items(t)
    return r.filter((F.col("state") == "active") & (F.col("expires_at") < T0 + 400_000)).select("reservation_id", "state")


@query(f"""WITH {X.ITEMS}, f AS (SELECT item_id, count(*) AS n FROM r WHERE state = 'active' AND expires_at < {T0 + 400_000} GROUP BY 1)
SELECT item_id, reserved - coalesce(n, 0) AS reserved, sold FROM i
LEFT JOIN f USING (item_id)""")
def ttl_sweep(t: Tables) -> DataFrame:
    return lifecycle.ttl_swept(*X.items(t), T0 + 400_000)[0].select("item_id", "reserved", "sold")


_RESERVE = f"""{X.ITEMS}, p AS (SELECT reservation_id, item_id, row_number() OVER (PARTITION BY item_id ORDER BY expires_at, reservation_id) AS n FROM r)"""


@query(f"WITH {_RESERVE} SELECT reservation_id, item_id, coalesce(n <= capacity, false) AS accepted FROM p LEFT JOIN i USING (item_id)")
def reserve_capacity(t: Tables) -> DataFrame:
    items, r = X.items(t)
    return folds.reserved(r, items, "item_id", ["expires_at", "reservation_id"]).select("reservation_id", "item_id", "accepted")


@query(f"""WITH {_RESERVE} SELECT reservation_id, item_id, again, NOT again AND coalesce(n <= capacity, false) AS accepted
FROM p LEFT JOIN i USING (item_id), (SELECT unnest([false, true]) AS again) x
WHERE NOT again OR reservation_id % 4 = 0""")
def reserve_legacy(t: Tables) -> DataFrame:
    """Requests of which some come twice: a seen id is not reserved again."""
    items, r = X.items(t)
    twice = r.withColumn("again", F.lit(False)).unionByName(r.filter("reservation_id % 4 = 0").withColumn("again", F.lit(True)))
    return folds.reserved(twice, items, "item_id", ["expires_at", "reservation_id", "again"]).select("reservation_id", "item_id", "again", "accepted")


@query(f"""WITH {X.ITEMS}, h AS (SELECT item_id, count(*) AS n FROM r WHERE state = 'active' AND reservation_id % 3 = 0 GROUP BY 1)
SELECT item_id, reserved - coalesce(n, 0) AS reserved, sold + coalesce(n, 0) AS sold
FROM i LEFT JOIN h USING (item_id)""")
def reserve_commit(t: Tables) -> DataFrame:
    items, r = X.items(t)
    return folds.committed(items, r, r.filter("reservation_id % 3 = 0"))[0].select("item_id", "reserved", "sold")


@query(f"""WITH {X.ITEMS}, b AS (SELECT item_id, capacity, reserved + CASE WHEN item_id % 17 = 0 THEN 1 ELSE 0 END AS counter, reserved AS a, sold AS s FROM i)
SELECT item_id, a + s > capacity AS oversold, counter <> a AS wrong_counter
FROM b WHERE a + s > capacity OR counter <> a""")
def reserve_gates(t: Tables) -> DataFrame:
    items, r = X.items(t)
    return folds.reservation_gates(items.withColumn("reserved", F.col("reserved") + F.when(F.col("item_id") % 17 == 0, 1).otherwise(0)), r)


def _transfers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(opening balances, operations) in groups of ten accounts that deal with each other."""
    grp = F.floor(F.col("c_custkey") / 10).alias("grp")
    opening = t.customer.select(grp, F.col("c_custkey").alias("account"), F.lit(5_000_000).cast("long").alias("cents"))
    k = F.col("o_custkey")
    base = F.floor(k / 10)
    ops = t.orders.select(base.alias("grp"), F.floor(F.col("o_orderkey") / 50).alias("round"), F.col("o_orderkey").alias("op"), k.alias("src"), (base * 10 + (k + 1) % 10).alias("dst"), S.cents(F.col("o_totalprice")).alias("cents"))
    return opening, ops


# Accounts of a group are a list by their last digit; one step of the recursion is one operation of every group.
_OPS = """op AS (SELECT o_custkey // 10 AS grp, o_orderkey // 50 AS round, o_orderkey AS op, o_custkey AS src, o_custkey // 10 * 10 + (o_custkey + 1) % 10 AS dst, round(o_totalprice * 100)::BIGINT AS cents,
  row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS i FROM orders),
ac AS (SELECT grp, list_transform(range(10), lambda j: CASE WHEN list_contains(list(a), j) THEN 5000000::BIGINT ELSE 0 END) AS bal
  FROM (SELECT c_custkey // 10 AS grp, c_custkey % 10 AS a FROM customer UNION ALL SELECT grp, NULL FROM op) GROUP BY grp)"""
_FOLD = f"""{_OPS}, f AS (SELECT grp, 0::BIGINT AS i, bal, 0::BIGINT AS op, 0::BIGINT AS src, 0::BIGINT AS dst, 0::BIGINT AS cents, false AS ok FROM ac
  UNION ALL SELECT f.grp, o.i, CASE WHEN f.bal[o.src % 10 + 1] >= o.cents THEN list_transform(f.bal, lambda x, j: x - CASE WHEN j = o.src % 10 + 1 THEN o.cents ELSE 0 END + CASE WHEN j = o.dst % 10 + 1 THEN o.cents ELSE 0 END) ELSE f.bal END,
  o.op, o.src, o.dst, o.cents, f.bal[o.src % 10 + 1] >= o.cents FROM f JOIN op o ON o.grp = f.grp AND o.i = f.i + 1)"""
_ROUNDS = f"""{_OPS}, f AS (SELECT grp, 0::BIGINT AS i, -1::BIGINT AS round, bal AS seen, bal FROM ac
  UNION ALL SELECT grp, i, round, seen, CASE WHEN seen[src % 10 + 1] >= cents THEN list_transform(bal, lambda x, j: CASE WHEN j = dst % 10 + 1 THEN seen[dst % 10 + 1] + cents WHEN j = src % 10 + 1 THEN seen[src % 10 + 1] - cents ELSE x END) ELSE bal END
  FROM (SELECT f.grp, o.i, o.round, o.src, o.dst, o.cents, f.bal, CASE WHEN o.round = f.round THEN f.seen ELSE f.bal END AS seen FROM f JOIN op o ON o.grp = f.grp AND o.i = f.i + 1))"""


@query(f"WITH RECURSIVE {_FOLD} SELECT grp, op, src, dst, cents, ok FROM f WHERE i > 0")
def transfer_fold(t: Tables) -> DataFrame:
    return folds.transfers(*_transfers(t), "grp")


@query(f"""WITH RECURSIVE {_ROUNDS} SELECT grp, (list_sum(arg_max(bal, i)) - list_sum(arg_min(bal, i)))::BIGINT AS drift FROM f WHERE grp IN (SELECT c_custkey // 10 FROM customer) GROUP BY grp""")
def transfer_naive(t: Tables) -> DataFrame:
    """Money that the naive strategy makes or loses in each group."""
    opening, ops = _transfers(t)
    after = folds.naive_transfers(opening, ops, "grp").groupBy("grp").agg(F.sum("cents").alias("a"))
    return opening.groupBy("grp").agg(F.sum("cents").alias("b")).join(after, "grp").select("grp", (F.col("a") - F.col("b")).cast("long").alias("drift"))


@query(f"""WITH RECURSIVE {_FOLD}, en AS (SELECT op, src AS account, -cents AS cents FROM f WHERE ok UNION ALL SELECT op, dst, cents FROM f WHERE ok)
SELECT op, account, cents, row_number() OVER (PARTITION BY account ORDER BY op, cents)::INT AS seq, (sum(cents) OVER (PARTITION BY account ORDER BY op, cents ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM en""")
def transfer_ledger(t: Tables) -> DataFrame:
    from ..operators.sequences import running_balance

    return running_balance(folds.entries(folds.transfers(*_transfers(t), "grp")), "account", ["op", "cents"], "cents")


@query(f"""WITH RECURSIVE {_FOLD}, la AS (SELECT unnest(arg_max(bal, i)) AS cents FROM f GROUP BY grp)
SELECT 'ledger' AS store, sum(cents)::BIGINT AS total, count(*) FILTER (WHERE cents < 0) AS negatives, sum(cents) = (SELECT count(*) * 5000000 FROM customer) AND count(*) FILTER (WHERE cents < 0) = 0 AS ok FROM la""")
def transfer_conserved(t: Tables) -> DataFrame:
    """The fold's balances sum to what there was, and none is below zero."""
    opening, ops = _transfers(t)
    net = folds.entries(folds.transfers(opening, ops, "grp")).groupBy("account").agg(F.sum("cents").alias("net"))
    after = opening.join(net, "account", "left").select("account", (F.col("cents") + F.coalesce("net", F.lit(0))).alias("cents"))
    total = t.customer.count() * 5_000_000
    return reconcile.conservation({"ledger": after}, total)


@query(f"WITH {X.EVENTS} SELECT pos, key FROM e WHERE pos <= 6000")
def lossy_migration(t: Tables) -> DataFrame:
    return lifecycle.lossy_copy(X.events(t), "pos", 6000)[0].select("pos", "key")


@query(f"WITH {X.EVENTS} SELECT pos, key FROM e WHERE ms >= (SELECT max(ms) FROM e) - 86400000")
def incr_copy(t: Tables) -> DataFrame:
    e = X.events(t)
    edge = e.agg(F.max("ms").alias("edge"))
    return lifecycle.incremental_copy(e.join(F.broadcast(edge)), F.col("ms") >= F.col("edge") - 86_400_000).select("pos", "key")


@query()
def cache_replay(t: Tables) -> DataFrame:
    """Reads of a cache under each strategy, replayed from the event log."""
    e = X.events(t).filter("kind IN ('click', 'purchase')")
    ops = e.select((F.col("key") % 40).alias("id"), F.col("ms").alias("ts"), "pos", F.when(F.col("kind") == "purchase", "write").otherwise("read").alias("op"), F.col("k").cast("double").alias("price"))
    parts = [folds.cache_replay(ops, "id", s, 30_000, 5_000).groupBy("source").agg(F.count("*").alias("reads")).withColumn("strategy", F.lit(s)) for s in ("ttl", "delete", "versioned", "cdc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
