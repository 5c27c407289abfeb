"""Counts, sums, percentiles, heavy hitters and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, sketches, topk
from ..sources import generators
from . import fixtures as X
from .fixtures import Tables
from .registry import query

K, WIDTH = 100, 64
WIDTHS = (512, 128, 64, 32)
_PAIRS = sketches.hash_params()
_HASH = lambda i: f"(({_PAIRS[i][0]}::HUGEINT * key::HUGEINT + {_PAIRS[i][1]}::HUGEINT) % {sketches.PRIME}::HUGEINT)"
_HASHED = ", ".join(["t AS (SELECT key, count(*) AS cnt FROM e GROUP BY key)", "hs AS (" + " UNION ALL ".join(f"SELECT key, cnt, {i}::INT AS row, {_HASH(i)}::BIGINT AS h FROM t" for i in range(4)) + ")"])
_CELLS = f"""{X.EVENTS}, {_HASHED}, cl AS (SELECT row, h % {WIDTH} AS cell, sum(cnt)::BIGINT AS cnt FROM hs GROUP BY 1, 2),
es AS (SELECT hs.key, min(cl.cnt) AS est FROM hs JOIN cl ON cl.row = hs.row AND cl.cell = hs.h % {WIDTH} GROUP BY 1)"""


@query(f"WITH {X.EVENTS} SELECT key, count(*) AS cnt FROM e GROUP BY key ORDER BY cnt DESC, key LIMIT {K}")
def topk_exact(t: Tables) -> DataFrame:
    return topk.top(topk.counts(X.events(t)), K)


@query(f"""WITH {X.MINUTES}, r AS (SELECT minute, key, count(*) AS cnt FROM m GROUP BY 1, 2)
SELECT key, sum(cnt)::BIGINT AS cnt FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def topk_rollup(t: Tables) -> DataFrame:
    return topk.top(topk.rollup_merged(topk.rollup(X.minutes(t), "minute"), by=("key",)), 20)


@query(f"WITH {X.MINUTES} SELECT minute, key, count(*) AS cnt FROM m GROUP BY 1, 2")
def minute_rollup(t: Tables) -> DataFrame:
    m = X.minutes(t)
    first, second = topk.rollup(m.filter("pos % 2 = 0"), "minute"), topk.rollup(m.filter("pos % 2 = 1"), "minute")
    return topk.rollup_merged(first, second, by=("minute", "key"))


@query(f"WITH {X.MINUTES} SELECT pos, minute FROM m")
def minute_bucket(t: Tables) -> DataFrame:
    return X.minutes(t).select("pos", "minute")


@query("SELECT o_orderkey AS rank, (o_orderkey * 2654435761) & 4294967295 AS id FROM orders")
def id_scramble(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("rank"), S.scrambled(F.col("o_orderkey")).alias("id"))


@query()
def topk_approx(t: Tables) -> DataFrame:
    return topk.approximate(X.events(t), 50)


_TRAP = """tr AS (SELECT minute, unnest([{'key': 1::BIGINT, 'cnt': 40}, {'key': 2, 'cnt': 40}, {'key': 3, 'cnt': 20}] || list_transform(range(15), lambda j: {'key': 1000 + 100 * minute + j, 'cnt': 30}), recursive := true) FROM range(60) AS g(minute))"""


def _trap_sql(n: int, rescored: bool) -> str:
    ranked = f"rk AS (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY cnt DESC, key) AS r FROM tr), kept AS (SELECT * FROM rk WHERE r <= {n})"
    source = "tr WHERE key IN (SELECT key FROM kept)" if rescored else "kept"
    return f"WITH {_TRAP}, {ranked} SELECT key, sum(cnt)::BIGINT AS cnt FROM {source} GROUP BY key ORDER BY cnt DESC, key LIMIT 10"


@query(_trap_sql(10, False))
def topk_trap_naive(t: Tables) -> DataFrame:
    return topk.summed_tops(generators.trap(t.spark), "minute", 10, 10)


@query(_trap_sql(20, True))
def topk_trap_wide(t: Tables) -> DataFrame:
    return topk.windowed(generators.trap(t.spark), "minute", 20, 10)


@query(f"WITH {_CELLS} SELECT row, cell, cnt FROM cl")
def cms_cells(t: Tables) -> DataFrame:
    return sketches.cells(X.events(t), WIDTH)


@query(f"WITH {_CELLS} SELECT key, est FROM es")
def cms_estimate(t: Tables) -> DataFrame:
    e = X.events(t)
    return sketches.estimates(e, sketches.cells(e, WIDTH), WIDTH)


@query(f"WITH {_CELLS} SELECT key, est FROM es ORDER BY est DESC, key LIMIT {K}")
def cms_topk(t: Tables) -> DataFrame:
    return cms_estimate(t).orderBy(F.desc("est"), "key").limit(K)


@query(f"WITH {_CELLS} SELECT row, cell, cnt FROM cl")
def cms_merge(t: Tables) -> DataFrame:
    e, shape = X.events(t), (WIDTH, sketches.DEPTH, sketches.SEED)
    halves = [(sketches.cells(e.filter(F.col("pos") % 2 == i), WIDTH), shape) for i in range(2)]
    return sketches.merged(*halves)


_BY_MINUTE = " UNION ALL ".join(f"SELECT minute, cnt, {i}::INT AS row, ({_HASH(i)} % {WIDTH})::BIGINT AS cell FROM tm" for i in range(4))


@query(f"""WITH {_CELLS}, m AS (SELECT key, least(pos * 60 // (SELECT count(*) FROM e), 59) AS minute FROM e), tm AS (SELECT minute, key, count(*) AS cnt FROM m GROUP BY 1, 2),
hm AS ({_BY_MINUTE}), cm AS (SELECT minute, row, cell, sum(cnt)::BIGINT AS cnt FROM hm GROUP BY ALL), sm AS (SELECT row, cell, sum(cnt)::BIGINT AS cnt FROM cm GROUP BY 1, 2)
SELECT count(*) AS differing FROM ((SELECT row, cell, cnt FROM sm EXCEPT SELECT row, cell, cnt FROM cl) UNION ALL (SELECT row, cell, cnt FROM cl EXCEPT SELECT row, cell, cnt FROM sm))""")
def cms_linearity(t: Tables) -> DataFrame:
    """Cells in which 60 merged minute sketches differ from the sketch of the whole stream."""
    m = X.minutes(t)
    summed = sketches.bucket_cells(m, "minute", WIDTH).groupBy("row", "cell").agg(F.sum("cnt").cast("long").alias("cnt"))
    whole = sketches.cells(m, WIDTH)
    return summed.exceptAll(whole).unionByName(whole.exceptAll(summed)).agg(F.count("*").alias("differing"))


@query(f"""WITH {X.EVENTS}, {_HASHED}, w AS (SELECT unnest([{', '.join(map(str, WIDTHS))}])::INT AS width),
x AS (SELECT width, key, cnt, row, h % width AS cell FROM hs, w),
c AS (SELECT width, row, cell, sum(cnt)::BIGINT AS total FROM x GROUP BY ALL)
SELECT x.width, x.key, max(x.cnt) AS cnt, min(c.total) AS est
FROM x JOIN c USING (width, row, cell) GROUP BY 1, 2""")
def cms_sweep(t: Tables) -> DataFrame:
    return sketches.sweep(X.events(t), WIDTHS)


@query()
def cms_cu(t: Tables) -> DataFrame:
    return sketches.conservative_cells(X.minutes(t), "minute", WIDTH)


@query()
def cms_heap(t: Tables) -> DataFrame:
    return sketches.candidate_heaps(X.minutes(t), "minute", 10, WIDTH)


@query(f"WITH {X.MINUTES} SELECT minute, 0::BIGINT AS violations FROM m GROUP BY minute")
def ss_guarantee(t: Tables) -> DataFrame:
    """For each minute the keys that break Space-Saving's guarantee."""
    m, counters = X.minutes(t), 40
    tracked = sketches.space_saving(m, "minute", counters).select("minute", "key", "cnt")
    truth = m.groupBy("minute", "key").agg(F.count("*").alias("true_cnt"))
    totals = truth.groupBy("minute").agg(F.sum("true_cnt").alias("n"))
    joined = truth.join(tracked, ["minute", "key"], "left").join(totals, "minute")
    bad = (F.col("cnt").isNull() & (F.col("true_cnt") * counters > F.col("n"))) | (F.col("cnt") < F.col("true_cnt"))
    return joined.groupBy("minute").agg(F.count(F.when(bad, 1)).alias("violations"))


def _tops(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth = topk.counts(X.events(t))
    return cms_topk(t).select("key", F.col("est").alias("cnt")), topk.top(truth, K), truth


_TOPS = f"""{_CELLS}, ap AS (SELECT key, est AS cnt, row_number() OVER (ORDER BY est DESC, key) AS ra FROM es QUALIFY ra <= {K}),
ex AS (SELECT key, cnt, row_number() OVER (ORDER BY cnt DESC, key) AS re FROM t QUALIFY re <= {K})"""


@query(f"""WITH {_TOPS} SELECT (SELECT count(*) FROM ap JOIN ex USING (key)) / {K}.0::DOUBLE AS recall, avg(abs(ap.cnt - t.cnt)) AS mean_err, max(abs(ap.cnt - t.cnt)) AS max_err
FROM ap JOIN t USING (key)""")
def sketch_metrics(t: Tables) -> DataFrame:
    return metrics.against_truth(*_tops(t), K)


@query(f"""WITH {_TOPS}, g AS (SELECT i, (SELECT count(*) FROM ap JOIN ex USING (key) WHERE ra <= i AND re <= i) / i::DOUBLE AS share FROM range(1, (SELECT count(*) FROM ex) + 1) AS x(i))
SELECT round(sum(share) / count(*), 9) AS overlap FROM g""")
def rank_overlap(t: Tables) -> DataFrame:
    approx, exact, _ = _tops(t)
    return metrics.rank_overlap(approx, exact).select(F.round("overlap", 9).alias("overlap"))


@query(f"""WITH {X.EVENTS}, t AS (SELECT key, count(*) AS cnt FROM e GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, key) AS a, row_number() OVER (ORDER BY cnt DESC, key DESC) AS b FROM t)
SELECT 'other ties' AS side, (SELECT list(cnt ORDER BY cnt) FROM r WHERE a <= {K}) = (SELECT list(cnt ORDER BY cnt) FROM r WHERE b <= {K}) AS equal
UNION ALL SELECT 'raised', (SELECT list(cnt ORDER BY cnt) FROM r WHERE a <= {K}) = (SELECT list(cnt + CASE WHEN b = 1 THEN 1 ELSE 0 END ORDER BY cnt) FROM r WHERE b <= {K})""")
def topk_tie_aware(t: Tables) -> DataFrame:
    """The exact top against one that breaks ties the other way, and against that with a count too high."""
    truth = topk.counts(X.events(t))
    want, other = topk.top(truth, K), truth.orderBy(F.desc("cnt"), F.desc("key")).limit(K)
    first = other.orderBy(F.desc("cnt"), F.desc("key")).limit(1).select("key", F.lit(1).alias("more"))
    raised = other.join(first, "key", "left").select("key", (F.col("cnt") + F.coalesce("more", F.lit(0))).alias("cnt"))
    sides = {"other ties": other, "raised": raised}
    parts = [metrics.tie_aware_equal(got, want, truth).select(F.lit(name).alias("side"), "equal") for name, got in sides.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_where(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").agg(F.count("*").alias("n"))


def _revenue(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")), F.lit(0)).cast("double").alias("revenue"))


@query("SELECT coalesce(sum(l_extendedprice::DECIMAL(12,2)), 0)::DOUBLE AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def revenue_filtered(t: Tables) -> DataFrame:
    return _revenue(t.lineitem.filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01'"))


@query("SELECT coalesce(sum(l_extendedprice::DECIMAL(12,2)), 0)::DOUBLE AS revenue FROM lineitem")
def revenue_unfiltered(t: Tables) -> DataFrame:
    return _revenue(t.lineitem)


@query("""SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates
FROM lineitem""")
def dup_count(t: Tables) -> DataFrame:
    per_key = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return per_key.agg(F.sum("c").cast("long").alias("n"), F.count("*").alias("distinct_n"), (F.sum("c") - F.count("*")).cast("long").alias("duplicates"))


@query("SELECT coalesce(min(o_orderkey), 0) AS low, coalesce(max(o_orderkey), 0) AS high FROM orders")
def minmax_bounds(t: Tables) -> DataFrame:
    return t.orders.agg(F.coalesce(F.min("o_orderkey"), F.lit(0)).alias("low"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("high"))


@query(f"WITH {X.ORDERS} SELECT priority, status, count(*) AS n FROM o GROUP BY 1, 2")
def state_hist(t: Tables) -> DataFrame:
    return X.orders(t).groupBy("priority", "status").agg(F.count("*").alias("n"))


def _pct_sql(ps: list[float], index: str) -> str:
    return f"WITH {X.ORDERS}, s AS (SELECT priority, cents, row_number() OVER (PARTITION BY priority ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY priority) AS n FROM o), p AS (SELECT unnest([{', '.join(map(str, ps))}])::DOUBLE AS p) SELECT priority, p, cents AS value FROM s, p WHERE i = {index}"


@query(_pct_sql([0.5, 0.95], "floor(p * (n - 1))"))
def pct_nearest(t: Tables) -> DataFrame:
    return metrics.nearest(X.orders(t), ["priority"], "cents", [0.5, 0.95])


@query(_pct_sql([50.0, 95.0, 99.0], "least(n - 1, floor(p / 100 * n))"))
def pct_index(t: Tables) -> DataFrame:
    return metrics.indexed(X.orders(t), ["priority"], "cents", [50.0, 95.0, 99.0])


@query(f"""WITH {X.ORDERS} SELECT priority, unnest([0.5, 0.95, 0.99])::DOUBLE AS p, round(unnest([quantile_cont(cents, 0.5), quantile_cont(cents, 0.95), quantile_cont(cents, 0.99)])::DOUBLE, 4) AS value
FROM o GROUP BY priority""")
def pct_inclusive(t: Tables) -> DataFrame:
    return metrics.inclusive(X.orders(t), ["priority"], "cents", [0.5, 0.95, 0.99]).select("priority", F.col("p").cast("double").alias("p"), F.round("value", 4).alias("value"))


@query("SELECT i AS id, i % 2 AS shard, md5(i::VARCHAR) AS body, i * 37 % 86400 AS age_s FROM range(1, 2001) AS g(i)")
def gen_series(t: Tables) -> DataFrame:
    return generators.series(t.spark, 2000)


@query("""WITH g AS (SELECT r AS round, w AS worker, r % 4 AS s FROM range(40) AS a(r), range(8) AS b(w)),
d AS (SELECT *, list_filter([(round + worker + 1) % 4, (round + worker + 2) % 4, (round + worker + 3) % 4], lambda x: x <> s)[1] AS dst0 FROM g)
SELECT round, worker, s + 1 AS src, dst0 + 1 AS dst, CASE WHEN s = 0 THEN 40000 ELSE 500 END + 100 * worker AS cents FROM d""")
def transfer_plan(t: Tables) -> DataFrame:
    return generators.transfer_plan(t.spark, 40, 8)


@query("SELECT p_partkey AS id, unnest(list_transform(range(2, least(15, length(p_brand)) + 1), lambda n: lower(p_brand)[1:n])) AS gram FROM part")
def edge_ngrams(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(S.edge_ngrams(F.col("p_brand"))).alias("gram"))


@query(f"""WITH {X.EVENTS} SELECT kind AS mode, count(*) AS ops, count(*) FILTER (WHERE k % 4 <> 0) AS acked, count(*) FILTER (WHERE k % 4 = 0) AS rejects, sum(k % 3)::BIGINT AS retries,
round(count(*) FILTER (WHERE k % 4 <> 0) * 1000.0::DOUBLE / greatest(1, max(ms) - min(ms)), 9) AS ops_s FROM e GROUP BY 1""")
def bench_summary(t: Tables) -> DataFrame:
    good = F.col("k") % 4 != 0
    wall = F.greatest(F.lit(1), F.max("ms") - F.min("ms"))
    return X.events(t).groupBy(F.col("kind").alias("mode")).agg(F.count("*").alias("ops"), F.count(F.when(good, 1)).alias("acked"), F.count(F.when(~good, 1)).alias("rejects"), F.sum(F.col("k") % 3).cast("long").alias("retries"), F.round(F.count(F.when(good, 1)) * 1000.0 / wall, 9).alias("ops_s"))
