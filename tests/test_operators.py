"""Operators on literal rows: known outcomes, plain-Python folds, and a broken variant of each gate that has to fail."""

import math
import random
import statistics
import uuid
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tally.functions import scalars as S
from tally.operators import asof, events, folds, ids, intervals, lifecycle, metrics, reconcile, routing, sequences, sketches, topk
from tally.sources import generators


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- heavy hitters ---


@pytest.fixture(scope="module")
def stream(spark):
    keys = generators.zipf_ids(6000, 800)
    return keys, spark.createDataFrame(list(enumerate(keys)), "pos long, key long").cache()


def test_exact_topk_and_rollup(stream):
    keys, df = stream
    want = sorted(Counter(keys).items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in topk.top(topk.counts(df), 50).collect()] == want[:50]
    minutes = generators.with_minutes(df, len(keys))
    assert {r.minute for r in minutes.select("minute").distinct().collect()} == set(range(60))
    assert [tuple(r) for r in topk.windowed(topk.rollup(minutes, "minute"), "minute", 800, 50).collect()] == want[:50]


def test_approximate_topk_recall(stream):
    keys, df = stream
    want = {k for k, _ in Counter(keys).most_common(50)}
    assert len({r.key for r in topk.approximate(df, 50).collect()} & want) >= 40


def dense(keys, width):
    table = [Counter() for _ in range(4)]
    for k in keys:
        for row, (a, b) in zip(table, sketches.hash_params()):
            row[(a * k + b) % sketches.PRIME % width] += 1
    return table


def test_sketch_cells_estimates_checksum_and_merge(stream):
    keys, df = stream
    width = 256
    table = dense(keys, width)
    sketch = sketches.cells(df, width)
    assert rows(sketch) == sorted(((i, c, n) for i, r in enumerate(table) for c, n in r.items()), key=str)
    est = {r.key: r.est for r in sketches.estimates(df, sketch, width).collect()}
    truth = Counter(keys)
    assert all(est[k] == min(t[(a * k + b) % sketches.PRIME % width] for t, (a, b) in zip(table, sketches.hash_params())) >= truth[k] for k in truth)
    import hashlib
    import struct

    flat = b"".join(struct.pack("<Q", r[c]) for r in table for c in range(width))
    assert sketches.checksum(sketch, width) == hashlib.sha256(flat).hexdigest()
    shape = (width, 4, sketches.SEED)
    halves = [sketches.cells(df.filter(F.col("pos") % 2 == i), width) for i in range(2)]
    assert sketches.checksum(sketches.merged((halves[0], shape), (halves[1], shape)), width) == sketches.checksum(sketch, width)
    with pytest.raises(ValueError):
        sketches.merged((halves[0], shape), (halves[1], (width * 2, 4, sketches.SEED)))
    assert sketches.memory_bytes(65536) == 2_097_152


def test_conservative_update_is_tighter_and_not_linear(stream):
    keys, df = stream
    width, truth = 128, Counter(keys)
    own = sketches.Conservative(width)
    for k in keys:
        own.update(k)
    got = sketches.conservative_cells(df.withColumn("bucket", F.lit(0)), "bucket", width).drop("bucket")
    assert rows(got) == sorted(own.cells(), key=str)
    table = dense(keys, width)
    vanilla = {k: min(t[p] for t, p in zip(table, own.places(k))) for k in truth}
    tight = {k: min(r.get(p, 0) for r, p in zip(own.rows, own.places(k))) for k in truth}
    assert all(truth[k] <= tight[k] <= vanilla[k] for k in truth) and sum(tight.values()) < sum(vanilla.values())
    halves = [sketches.conservative_cells(df.filter(F.col("pos") % 2 == i).withColumn("bucket", F.lit(0)), "bucket", width).drop("bucket") for i in range(2)]
    shape = (width, 4, sketches.SEED)
    assert rows(sketches.merged((halves[0], shape), (halves[1], shape))) != rows(got)


def test_space_saving_and_candidate_heap(stream):
    keys, df = stream
    truth, m = Counter(keys), 200
    s = sketches.SpaceSaving(m)
    count, error = {}, {}
    for k in keys:  # the same rule with a plain minimum
        s.update(k)
        if k in count:
            count[k] += 1
        elif len(count) < m:
            count[k], error[k] = 1, 0
        else:
            least, victim = min((c, x) for x, c in count.items())
            del count[victim], error[victim]
            count[k], error[k] = least + 1, least
    assert s.count == count and s.error == error
    assert all(c >= truth[k] for k, c in count.items()) and all(k in count for k, f in truth.items() if f > len(keys) / m)
    folded = sketches.space_saving(df.withColumn("bucket", F.lit(1)), "bucket", m)
    assert {(r.key, r.cnt, r.err) for r in folded.collect()} == {(k, c, error[k]) for k, c in count.items()}
    exact = topk.counts(df)
    assert sketches.space_saving_violations(folded, exact, m, len(keys)).count() == 0
    broken = folded.withColumn("cnt", F.col("cnt") - F.lit(1_000))
    assert sketches.space_saving_violations(broken, exact, m, len(keys)).count() > 0
    heap = sketches.candidate_heaps(df.withColumn("bucket", F.lit(1)), "bucket", 20, 4096)
    assert len({r.key for r in heap.collect()} & {k for k, _ in truth.most_common(20)}) >= 18


def test_metrics(spark):
    exact = spark.createDataFrame([(i, 100 - i) for i in range(10)], "key long, cnt long")
    approx = spark.createDataFrame([(i, 103 - i) for i in (1, 0, 2, 3, 4, 5, 6, 7, 20, 21)], "key long, cnt long")
    truth = exact.unionByName(spark.createDataFrame([(20, 5), (21, 5)], "key long, cnt long"))
    r = metrics.against_truth(approx, exact, truth, 10).first()
    assert r.recall == 0.8 and r.max_err == 78
    a = [k for k, _ in sorted(((x.key, x.cnt) for x in approx.collect()), key=lambda x: (-x[1], x[0]))]
    want = sum(len(set(a[:i]) & set(range(i))) / i for i in range(1, 11)) / 10
    assert abs(metrics.rank_overlap(approx, exact).first().overlap - want) < 1e-12


def test_rank_overlap_of_lists_that_share_nothing(spark):
    table = lambda *keys: spark.createDataFrame([(k, 9 - i) for i, k in enumerate(keys)], "key long, cnt long")
    cases = {((1, 2), (3, 4)): 0.0, ((), (3, 4)): 0.0, ((3, 9), (4, 3)): 0.25, ((4, 3), (4, 3)): 1.0, ((1, 2, 3), (3,)): 0.0, ((1, 2), ()): None}
    assert {x: [r.overlap for r in metrics.rank_overlap(table(*x[0]), table(*x[1])).collect()] for x in cases} == {x: [want] for x, want in cases.items()}


def test_tie_aware_equality(spark):
    table = lambda *x: spark.createDataFrame(x, "key long, cnt long")
    truth, want = table((1, 5), (2, 3), (9, 3), (4, 1)), table((1, 5), (9, 3))
    cases = {((1, 5), (2, 3)): True, ((1, 5), (9, 3)): True, ((2, 5), (1, 3)): False, ((1, 5), (4, 3)): False, ((1, 5), (8, 3)): False, ((1, 5),): False, ((1, 5), (1, 5)): False, ((1, 5), (4, 1)): False}
    assert {got: metrics.tie_aware_equal(table(*got), want, truth).first().equal for got in cases} == cases


def test_bounded_memory_of_the_ordered_sketches():
    """What they hold is bounded by their counters, however long the stream."""
    m, n = 50, 60_000
    rng = random.Random(2)
    s, c = sketches.SpaceSaving(m), sketches.Candidates(m, width=1 << 10)
    for _ in range(n):
        key = int(rng.paretovariate(0.7))
        s.update(key)
        c.update(key)
        assert len(s.count) <= m and len(s.floor.order) <= m and len(c.estimate) <= m and len(c.floor.order) <= m
    assert len(s.error) == m and sum(s.count.values()) == n


def test_many_intervals_of_one_part(spark):
    n = 1_100_000
    text = "u:" + ":".join(str(2 * i) for i in range(n))
    assert intervals.set_size(intervals.parsed_sets(spark.createDataFrame([(text,)], "s string"), "s")).first().n == n
    assert intervals.parsed_sets(spark.createDataFrame([("u",), ("",), (None,)], "s string"), "s").collect() == []


def test_percentiles(spark):
    rng = random.Random(1)
    xs = [rng.randrange(1000) for _ in range(137)]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, v long")
    xs.sort()
    assert {r.p: r.value for r in metrics.nearest(df, ["g"], "v", [0.5, 0.95]).collect()} == {p: xs[int(p * 136)] for p in (0.5, 0.95)}
    assert {r.p: r.value for r in metrics.indexed(df, ["g"], "v", [50.0, 99.0, 100.0]).collect()} == {p: xs[min(136, int(p / 100 * 137))] for p in (50.0, 99.0, 100.0)}
    q = statistics.quantiles(xs, n=100, method="inclusive")
    got = {float(r.p): r.value for r in metrics.inclusive(df, ["g"], "v", [0.5, 0.95]).collect()}
    assert math.isclose(got[0.5], q[49]) and math.isclose(got[0.95], q[94])


# --- scalars and identifiers ---


def test_names(spark):
    names = ["Ada Lovelace", "Mary Jane Watson", "Prince", "A B C D", " leading", "trailing ", "double  space", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r[0]: (r[1], r[2]) for r in df.select("name", S.name_first(F.col("name")), S.name_last(F.col("name"))).collect()}
    for n in names:
        if n is None:
            assert got[n] == (None, None)
        else:
            first, space, last = n.rpartition(" ")
            assert got[n] == ((first, last) if space else (n, ""))
    pairs = spark.createDataFrame([(None, None), ("a", None), ("", "b"), ("a", "b"), ("", "")], "f string, l string")
    assert [r[0] for r in pairs.select(S.name_composed(F.col("f"), F.col("l"))).collect()] == [None, "a", "b", "a b", ""]


def test_hashes_agree_with_plain_python(spark):
    probes = [1, 7, 42, 1999, 123456789]
    df = spark.createDataFrame([(p,) for p in probes], "k long")
    assert [r[0] for r in df.select(S.shard_crc(F.col("k"), 4)).collect()] == [zlib.crc32(str(p).encode()) % 4 for p in probes]
    assert [r[0] for r in df.select(S.scrambled(F.col("k"))).collect()] == [p * 2654435761 & 0xFFFFFFFF for p in probes]


def test_packed_ids_and_uuids(spark):
    cases = [(0, 0, 0), ((1 << 41) - 1, 1023, 4095), (123_456_789, 511, 2048)]
    df = spark.createDataFrame(cases, "t long, w int, s int")
    packed = df.select(S.packed_id(F.col("t"), F.col("w"), F.col("s")).alias("id"))
    assert [r.id for r in packed.collect()] == [ids.packed(*c) for c in cases]
    assert [tuple(r) for r in packed.select(*S.unpacked_id(F.col("id")).values()).collect()] == cases
    u = uuid.UUID(spark.range(1).select(S.uuid7(F.lit(1_700_000_000_123))).first()[0])
    assert u.version == 7 and u.int >> 80 == 1_700_000_000_123 and u.variant == uuid.RFC_4122


GOOD, BACK = [100] * 3 + [101] * 3 + [102] * 3, [100] * 3


def test_generators_on_a_scripted_clock():
    naive = ids.NaiveGenerator(1, ids.scripted(GOOD + BACK)).issued(12)
    assert len(naive) == 12 and len(naive) - len(set(naive)) == 3
    error = ids.Generator(1, ids.scripted(GOOD + BACK), "error").issued(12)
    assert len(error) == 9 == len(set(error))
    hold = ids.Generator(1, ids.scripted(GOOD + BACK), "hold").issued(12)
    assert len(hold) == 12 and hold == sorted(set(hold))
    wait = ids.Generator(1, ids.scripted(GOOD + [100, 101, 102, 103]), "wait").issued(13)
    assert wait == sorted(set(wait)) and len(wait) == 11
    assert ids.Generator(1, ids.scripted([900, 100]), "wait").issued(2) == [ids.packed(900, 1, 0)]
    with pytest.raises(ValueError):
        ids.Generator(1, ids.scripted([]), "other")


def test_generators_on_a_frozen_clock():
    naive = ids.NaiveGenerator(1, ids.scripted([500] * 5000)).issued(5000)
    assert len(naive) - len(set(naive)) == 904
    steps = [500] * 4096 + [500, 500, 501] + [501] * 903
    hardened = ids.Generator(1, ids.scripted(steps)).issued(5000)
    assert len(set(hardened)) == 5000


def test_generated_ids_fold(spark):
    df = spark.createDataFrame([(w, i, t) for w in (1, 2) for i, t in enumerate(GOOD + BACK)], "worker int, pos int, ts long")
    got = folds.generated_ids(df, "worker", "naive")
    assert {r.worker: r.n for r in got.groupBy("worker").agg((F.count("*") - F.count_distinct("id")).alias("n")).collect()} == {1: 3, 2: 3}


def test_edge_ngrams(spark):
    got = spark.createDataFrame([("Ab",), ("x",), ("abcdefghijklmnopqr",), (None,)], "w string").select(S.edge_ngrams(F.col("w"))).collect()
    assert got[0][0] == ["ab"] and got[1][0] == [] and len(got[2][0]) == 14 and not got[3][0]


# --- reconciliation ---


def test_diff_repair_and_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "z", 7), (4, None, 1)], "id long, status string, cents long")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 3), (4, None, 1), (9, "q", 0)], "id long, status string, cents long")
    fields = ["status", "cents"]
    assert rows(reconcile.classified(a, b, "id", fields)) == [(2, "stale"), (3, "missing"), (9, "orphan")]
    fixed = reconcile.repaired(a, b, "id", fields)
    assert reconcile.classified(a, fixed, "id", fields).count() == 0 and rows(fixed) == rows(a)
    corrupt = a.withColumn("cents", F.when(F.col("id") == 3, 1007).otherwise(F.col("cents")))
    one, two = (reconcile.fingerprint(d, [], ["id", "status", "cents"]).first() for d in (a, corrupt))
    assert one.n == two.n and one.print != two.print
    assert rows(reconcile.range_checksum(a, "id", 10, ["id", "cents"])) != rows(reconcile.range_checksum(corrupt, "id", 10, ["id", "cents"]))
    assert rows(reconcile.fingerprint(a.repartition(3), [], ["id", "cents"])) == rows(reconcile.fingerprint(a, [], ["id", "cents"]))


def test_presence_and_exactly_once(spark):
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(reconcile.xor_presence(n(1, 2, 3, 4), n(1, 3), n(2, 3), "id")) == [(3, True, True), (4, False, False)]
    assert rows(reconcile.exactly_once(n(1, 2, 3), n(1, 2, 2, 5), "id")) == [(2, 1, 2), (3, 1, 0), (5, 0, 1)]
    assert rows(reconcile.unaccounted(n(1, 2), n(2, 3), "id")) == [(1, "expected"), (3, "found")]
    assert rows(reconcile.store_diff(n(1, 2), n(2, 3), "id")) == [(1, "a"), (3, "b")]


def test_drift_and_conservation(spark):
    e = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "id long, cents long")
    a = spark.createDataFrame([(1, 130), (2, 90), (3, 100)], "id long, cents long")
    sums, drift = reconcile.drift_split(e, a, "id")
    assert tuple(sums.first()) == (30, 10, 2) and rows(drift) == [(1, 30), (2, -10)]
    assert tuple(reconcile.drift_split(e, e, "id")[0].first()) == (0, 0, 0)
    got = {r.store: r.ok for r in reconcile.conservation({"good": e, "bad": a, "negative": e.withColumn("cents", F.when(F.col("id") == 1, -1).otherwise(F.lit(151)))}, 300).collect()}
    assert got == {"good": True, "bad": False, "negative": False}


def test_gate(spark):
    empty, one = spark.range(0), spark.range(1)
    assert rows(lifecycle.gate({"a": empty, "b": one})) == [("a", 0, True), ("b", 1, False)]


# --- sequences, intervals, as-of ---


def test_fencing(spark):
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate([1, 1, 2, 2, 1, 3, 2])], "r string, idx int, token int")
    assert [x.accepted for x in sequences.fenced(df, "r", "idx", "token").orderBy("idx").collect()] == [True, True, True, True, False, True, False]
    ledger = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (1, 3), (2, 4)], "s int, idx int")
    assert rows(intervals.interleaved(ledger, "s", "idx")) == [(1, 1), (2, 1)]
    assert rows(intervals.interleaved(ledger.filter("idx < 3"), "s", "idx")) == []


def test_leases(spark):
    log = [("w", 0, "a", "claim", 0, 100), ("w", 1, "a", "renew", 50, 900), ("w", 2, "b", "claim", 300, 400), ("w", 3, "c", "claim", 600, 700), ("w", 4, "c", "release", 650, 700), ("w", 5, "d", "claim", 2000, 2100)]
    df = spark.createDataFrame(log, "worker string, pos int, owner string, event string, at long, expires_at long")
    s = sequences.sessions(df, "worker", "pos")
    assert sorted((r.owner, r.start_ms, r.end_ms) for r in s.collect()) == [("a", 0, 900), ("b", 300, 400), ("c", 600, 650), ("d", 2000, 2100)]
    for width in (10, 137, 5000):  # the long first interval meets two that aren't next to it
        assert rows(intervals.overlaps(s, "worker", width)) == [("w", "a", "b", 300, 400), ("w", "a", "c", 600, 650)]


def as_set(df):
    return {(r.uuid, x) for r in df.collect() for x in range(r.lo, r.hi + 1)}


def test_transaction_sets(spark):
    df = spark.createDataFrame([("m", "u:1-5:7,v:1-3")], "node string, text string")
    sets = intervals.parsed_sets(df, "text", "node")
    assert rows(intervals.set_size(sets)) == [(9,)]
    rng = random.Random(3)
    for _ in range(3):
        pick = lambda: ",".join(f"{u}:" + ":".join(f"{a}-{a + rng.randrange(4)}" for a in (rng.randrange(1, 30) for _ in range(5))) for u in "uv")  # noqa: B023, E731
        two = [spark.createDataFrame([(pick(),)], "text string") for _ in range(2)]
        a, b = (intervals.parsed_sets(d, "text") for d in two)
        assert as_set(intervals.subtracted(a, b)) == as_set(a) - as_set(b)
        assert as_set(intervals.merged_sets(a.unionByName(b))) == as_set(a) | as_set(b)
    nodes = spark.createDataFrame([("p", "u:1-9"), ("q", "u:1-4:6"), ("r", "u:2-9")], "node string, text string")
    assert rows(intervals.largest_set(intervals.parsed_sets(nodes, "text", "node"), "node")) == [("p", 9)]
    assert rows(intervals.largest_set(intervals.parsed_sets(nodes.filter("node <> 'p'"), "text", "node"), "node")) == []


def plain_audit(reads, writes):
    out = []
    for strategy, i, ts, price, _ in reads:
        history = sorted((w[2], w[3]) for w in writes if w[:2] == (strategy, i))
        seen = [h for h in history if h[0] <= ts + 100]
        if not seen or seen[-1][1] == price:
            out.append((bool(seen), False, None))
            continue
        origin = max((j for j, h in enumerate(history) if h[1] == price and h[0] <= ts), default=None)
        since = history[0][0] if origin is None else history[origin + 1][0] if origin + 1 < len(history) else ts
        out.append((True, True, max(0, ts - since)))
    return Counter(out)


def test_staleness(spark):
    rng = random.Random(2)
    writes = [("s", i, t, float(rng.randrange(4))) for i in range(3) for t in sorted(rng.sample(range(0, 5000, 7), 25))]
    reads = [(rng.choice(["s", "t"]), rng.randrange(4), rng.randrange(5200), float(rng.randrange(5)), "cache") for _ in range(300)]
    w = spark.createDataFrame(writes, "strategy string, id int, ts long, price double")
    r = spark.createDataFrame(reads, "strategy string, id int, ts long, price double, source string")
    got = asof.stale_reads(r, w)
    assert Counter((x.judged, x.stale, x.staleness_ms) for x in got.collect()) == plain_audit(reads, writes)
    s = {x.strategy: x for x in asof.summary(got).collect()}
    assert s["t"].judged == 0 and s["t"].stale_pct == 0 and s["s"].hit_rate == 100


def test_chunks_and_gaps(spark):
    ids_ = spark.createDataFrame([(i * 3,) for i in range(95)], "k long")
    got = sorted(map(tuple, sequences.chunk_bounds(ids_.repartition(4), "k", 10).collect()))
    assert got == [(c, c * 30, min(c * 10 + 9, 94) * 3, min(10, 95 - c * 10)) for c in range(10)]
    seqs = generators.contiguous(spark, 5, 4)
    assert sequences.gaps(seqs, "user_id", "seq").count() == 0
    assert rows(sequences.gaps(seqs.filter("NOT (user_id = 2 AND seq = 3)"), "user_id", "seq")) == [(2, 3, 4)]


# --- events ---


def test_actions_and_state(spark):
    df = spark.createDataFrame([(i, 1, op, v) for i, (op, v) in enumerate([("r", 1), ("c", 2), ("u", 3), (None, 4), ("x", 5)])] + [(9, 2, "c", 1), (10, 2, "d", None)], "pos int, key int, op string, v int")
    assert [r[0] for r in df.orderBy("pos").select(events.action(F.col("op"))).collect()] == ["upsert"] * 3 + ["skip"] * 2 + ["upsert", "delete"]
    state = events.final_state(df, "key", "pos", ["v"])
    assert rows(state) == [(1, 3)] == rows(events.final_state(df.unionByName(df), "key", "pos", ["v"]))


def test_poison(spark):
    good = '{"event_id":"a","account_id":1,"amount":5}'
    bad = ['{"event_id":"a","account_id":1,"amount":"NaN"}', '{"event_id":"a","account_id":1,"amount":5.0}', "not json", '{"event_id":"a","account_id":1,"amount":true}', '{"event_id":"a","amount":5}', '{"account_id":1,"amount":5}', None, ""]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "value string")
    assert [r.ok for r in events.validated(df).collect()] == [True] + [False] * len(bad)


def test_dedupe_and_replay(spark):
    deliveries = [(i, i, 1, 10) for i in range(1, 11)] + [(100 + i, i, 1, 10) for i in range(4, 8)]
    df = spark.createDataFrame(deliveries, "pos int, event int, account int, amount int")
    assert rows(events.applied_naively(df, "account", "amount")) == [(1, 140)]
    assert rows(events.applied_once(df, "event", "pos", "account", "amount")) == [(1, 100)]
    again, unknown = events.replayed(spark.createDataFrame([(4,), (77,)], "event int"), df.filter("pos <= 10"), "event", 3)
    assert again.count() == 3 and rows(unknown) == [(77,)]


# --- folds and lifecycle ---


def test_transfers(spark):
    rng = random.Random(4)
    opening = [(g, g * 10 + i, 1000) for g in range(3) for i in range(4)]
    ops = [(g, n // 6, n, g * 10 + rng.randrange(4), g * 10 + rng.randrange(4), rng.randrange(1, 900)) for g in range(3) for n in range(60)]
    ops = [o for o in ops if o[3] != o[4]]
    a = spark.createDataFrame(opening, "g int, account long, cents long")
    b = spark.createDataFrame(ops, "g int, round long, op long, src long, dst long, cents long")
    balance = {x[1]: x[2] for x in opening}
    want = []
    for g, _, n, s, d, c in sorted(ops, key=lambda o: (o[0], o[2])):
        ok = balance[s] >= c
        if ok:
            balance[s] -= c
            balance[d] += c
        want.append((g, n, s, d, c, ok))
    done = folds.transfers(a, b, "g")
    assert rows(done) == sorted(want, key=str)
    moved = {r.account: r.n for r in folds.entries(done).groupBy("account").agg(F.sum("cents").alias("n")).collect()}
    assert {k: 1000 + moved.get(k, 0) for k in balance} == balance and min(balance.values()) >= 0
    naive = folds.naive_transfers(a, b, "g")
    assert naive.agg(F.sum("cents")).first()[0] != 12_000  # it makes or loses money


def test_reservation_lifecycle(spark):
    """Exhaust, commit ten, sweep, and capacity less ten is free again."""
    items = spark.createDataFrame([(1, 40, 40, 0)], "item_id int, capacity long, reserved long, sold long")
    r = spark.createDataFrame([(i, 1, i) for i in range(60)], "reservation_id int, item_id int, ts int")
    held = folds.reserved(r, items, "item_id", ["ts"]).filter("accepted").select("reservation_id", "item_id", F.lit("active").alias("state"), F.lit(100).alias("expires_at"))
    assert held.count() == 40
    assert folds.reservation_gates(items, held).count() == 0
    assert folds.reservation_gates(items.withColumn("capacity", F.lit(39)), held).count() == 1
    commits = held.filter("reservation_id < 10")
    sold, after = folds.committed(items, held, commits.unionByName(commits))
    assert rows(sold.select("reserved", "sold")) == [(30, 10)] == rows(folds.committed(sold, after, commits)[0].select("reserved", "sold"))
    swept, last = lifecycle.ttl_swept(sold, after, 200)
    assert rows(swept.select("reserved", "sold")) == [(0, 10)] == rows(lifecycle.ttl_swept(swept, last, 200)[0].select("reserved", "sold"))
    assert folds.reservation_gates(swept, last).count() == 0


def test_cache_strategies(spark):
    ops = [(1, 0, 0, "write", 1.0), (1, 10, 1, "read", 0.0), (1, 20, 2, "write", 2.0), (1, 30, 3, "read", 0.0), (1, 80, 4, "read", 0.0), (1, 200, 5, "read", 0.0)]
    df = spark.createDataFrame(ops, "id int, ts long, pos long, op string, price double")
    served = lambda s: [(r.price, r.source) for r in folds.cache_replay(df, "id", s, 100, 40).orderBy("ts").collect()]
    assert served("ttl") == [(1.0, "db"), (1.0, "cache"), (1.0, "cache"), (2.0, "db")]
    assert served("delete") == served("versioned") == [(1.0, "db"), (2.0, "db"), (2.0, "cache"), (2.0, "db")]
    assert served("cdc") == [(1.0, "db"), (1.0, "cache"), (2.0, "db"), (2.0, "db")]
    with pytest.raises(ValueError):
        folds.cache_replay(df, "id", "none", 1)


def test_moves_and_schema(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    stay, gone = lifecycle.moved(t, t.filter("id = 2").select("id"), "id", 5, "why")
    back, left = lifecycle.restored(stay, gone, t.filter("id = 2").select("id"), "id")
    assert rows(back) == rows(t) and left.count() == 0
    wide = t.withColumn("y", F.lit(1))
    assert rows(lifecycle.schema_drift(t, wide)) == [("y", "b")] and lifecycle.schema_drift(t, t).count() == 0
    assert lifecycle.aligned_union(t, wide).columns == ["id", "x", "y"]
    assert lifecycle.shared_columns(wide, t) == ["id", "x"]
    live, archive = lifecycle.archived(t, F.col("id") > 0, 9, 1, "id")
    assert rows(live) == [(2, "b")] and rows(archive) == [(1, "a", 9)]
    fixed = lifecycle.converged(spark.createDataFrame([("a b", None, None), ("c", "c", ""), (None, "k", "k"), ("x y", "x", None)], "name string, first_name string, last_name string"))
    assert fixed.filter(lifecycle.needs_fix()).count() == 0


def test_routes(spark):
    ops = spark.createDataFrame([("write", m) for m in routing.MODES] + [("read", m) for m in routing.MODES], "op string, mode string")
    got = rows(routing.routed(ops, F.col("mode"), F.lit("s1")))
    assert got == sorted([("write", "single", "mono", "authoritative"), ("read", "single", "mono", "authoritative")] + [("write", m, n, leg) for m in ("double-write", "shadow-read") for n, leg in (("mono", "authoritative"), ("s1", "best-effort"))] + [("write", "sharded", "s1", "authoritative"), ("write", "sharded", "mono", "best-effort"), ("read", "double-write", "mono", "authoritative"), ("read", "shadow-read", "mono", "authoritative"), ("read", "shadow-read", "s1", "shadow"), ("read", "sharded", "s1", "authoritative")], key=str)


def test_plan_of_transfers(spark):
    for r in generators.transfer_plan(spark, 12, 8).collect():
        assert r.src == r.round % 4 + 1 and r.src != r.dst and r.cents == (40000 if r.round % 4 == 0 else 500) + 100 * r.worker


def test_dual_write_and_outbox(spark):
    events_ = spark.range(1, 101).select(F.col("id").alias("pos"), F.col("id").alias("event"), F.lit(1).alias("account"), F.lit(10).alias("amount"))
    dual, outbox = (generators.published(events_, 10, o) for o in (False, True))
    assert dual.count() == 90 and outbox.count() == 105
    assert rows(reconcile.exactly_once(events_, dual, "pos"))[0][1:] == (1, 0)
    assert rows(events.applied_once(outbox, "event", "pos", "account", "amount")) == [(1, 1000)]


def test_reports_joined(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "strategy string, stale long")
    b = spark.createDataFrame([("x", 9)], "strategy string, reads long")
    assert rows(metrics.combined(a, b, "strategy")) == [("x", 1, 9), ("y", 2, None)]


def test_generated_mixes(spark):
    mix = generators.write_mix(spark, 20_000, {"insert": 0.6, "update": 0.35, "delete": 0.05}, 100)
    share = {r.op: r.n / 20_000 for r in mix.groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert abs(share["insert"] - 0.6) < 0.02 and abs(share["delete"] - 0.05) < 0.01
    z = generators.zipf_stream(spark, 20_000, 1000)
    top = topk.top(topk.counts(z), 1).first()
    assert top.key == 2654435761 and top.cnt > 1000
    assert [r.cnt for r in topk.top(generators.trap(spark).groupBy("key").agg(F.sum("cnt").alias("cnt")), 3).collect()] == [2400, 2400, 1200]
    assert generators.with_duplicates(spark.range(1000), 0.5, "id").count() > 1300
    messages = spark.createDataFrame([(1, '{"amount": 5}'), (2, '{"amount": 6}')], "pos int, value string")
    assert [r.value for r in generators.with_poison(messages, 2, "pos").collect()] == ['{"amount": 5}', '{"amount": "6"}']
