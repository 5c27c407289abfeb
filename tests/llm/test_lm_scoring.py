"""The recurrent model's gradient and probabilities, the base model by hand, and held-out likelihood."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa

from tally.llm import common as C
from tally.llm import gru
from tally.llm import lm_scoring as L


def model(units=11, seed=3):
    shape = gru.Shape(units, hidden=5, embedding=4)
    rng = np.random.default_rng(seed)
    vector = gru.initial(shape, rng.random(units) + 0.1).astype(np.float64)
    pad = gru.split(vector, shape)["ub"] < -1e8
    vector += rng.normal(0, 0.3, len(vector))
    gru.split(vector, shape)["ub"][pad] = -1e9
    return shape, vector


def test_units_are_a_distribution():
    shape, vector = model()
    states = np.random.default_rng(0).normal(size=(4, shape.hidden))
    p = gru.split(vector, shape)
    total = sum(np.exp(gru.log_probabilities(p, shape, states, np.full(4, u))) for u in range(shape.units))
    assert np.allclose(total, 1)


def test_untrained_model_is_the_unigram_model():
    mass = np.array([5.0, 3.0, 1.0, 0.5, 0.5])
    shape = gru.Shape(5)
    got = gru.score(gru.initial(shape, mass), shape, [np.array([0, 1, 4, 0])], 0)
    assert np.allclose(got, np.log(mass / 10)[[0, 1, 4, 0]].sum(), atol=1e-4)


def test_gradient_by_differences(monkeypatch):
    monkeypatch.setattr(gru, "FLOAT", np.float64)
    shape, vector = model()
    rng = np.random.default_rng(5)
    target, given = rng.integers(0, shape.units, (2, 6, 3))
    start = rng.random((6, 3)) < 0.2
    live = np.array([3, 3, 3, 2, 2, 1])
    h = rng.normal(size=(3, shape.hidden))
    _, grad, _ = gru.gradient(vector, shape, h, target, given, start, live)
    for i in rng.choice(len(vector), 150, replace=False):
        ends = []
        for e in (1e-5, -1e-5):
            moved = vector.copy()
            moved[i] += e
            ends.append(gru.gradient(moved, shape, h, target, given, start, live)[0])
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[i]) < 1e-4


def test_state_is_carried_over_whole_documents():
    shape, vector = model()
    vector = vector.astype(np.float32)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, shape.units, n) for n in (1, 7, 300, 2, 50, 50, 131)]
    p = gru.split(vector, shape)
    want = []
    for d in docs:
        h, total = np.zeros((1, shape.hidden), np.float32), 0.0
        for before, t in zip([3, *d[:-1]], d):
            h = gru._step((p["embed"][[before]] @ p["wx"] + p["b"]), h, p["wh"], shape.hidden)[0]
            total += gru.log_probabilities(p, shape, h, np.array([t]))[0]
        want.append(total)
    for steps in (5, 48, 1000):
        assert np.allclose(gru.score(vector, shape, docs, 3, steps), want, rtol=1e-4)


def base(rows):
    tokens = [[*brute.WORD.findall(brute.lower(t or "")), ""] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, _), h, ws in zip(rows, held, tokens)]


def check(df, rows):
    got = sorted((tuple(r)[:6] for r in df), key=str)
    want = sorted(base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_base_model(docs_of):
    rows = [(i, f"the Word {i % 7} and\tword {i} É é") for i in range(60)] + [(None, "the null"), (100, None), (101, ""), (2**63 - 1, "the last"), (5, "again the"), (5, "again the"), (200, "long " * 50000)]
    for size in (L.PACK_BYTES, 200):
        out = L.report(docs_of(rows), pack_bytes=size).collect()
        check(out, rows)
        assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    assert L.report(docs_of([])).collect() == []
    nothing = [(d, "no training rows") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    check(L.report(docs_of(nothing)).collect(), nothing)


def test_held_out_likelihood(spark):
    docs = C.documents(spark, "/root/testdata/sf0.01")
    out = L.report(docs, stride=1, rounds=2).toPandas()
    check([tuple(r) for r in out.itertuples(index=False)], [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.97
    assert (held.score > held.base_score).mean() > 0.9


def test_every_training_document_is_learnt_from(spark):
    """At the parameters of the query."""
    turns = {zlib.crc32(str(x).encode(), 17) % L.STRIDE for x in range(10_000) if not L.held_out(x)}
    assert turns == {turn % L.STRIDE for turn in range(L.ROUNDS)}
    out = L.report(C.documents(spark, "/root/testdata/sf0.01")).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.97
    assert (held.score > held.base_score).mean() > 0.9


def test_words_of_texts():
    texts = ["", " ", "a", "  a\x0b\x0cB\r\n c ", "\x1c\x85 é x Y \x00", "\x1f\x00 Z", "\u2003İ ẞ\tK\n"]
    words, counts = L._words(pa.array(["left out", *texts]).slice(1))
    want = [[*t.encode().lower().split(), L.END] for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == list(map(len, want))
    words, counts = L._words(pa.array([], pa.string()))
    assert len(words) == len(counts) == 0


def test_rows_of_a_pack_come_in_any_order():
    bind = L._bind(100, 10, {L.WORD_UNITS: 5.0})
    rows = []
    for pack, (dids, sizes, tokens) in {4: ([7, None], [3, 1], [2, 0, 1, 1]), 9: ([8], [2], [0, 1])}.items():
        rows.append((pack, -1, L._packed(dids, sizes, np.array(tokens, np.uint32)), None))
        rows += [(pack, n * L.PLACES + (L.WORD_UNITS if n == 2 else 5 + n), None, 10 * n) for n in range(max(tokens) + 1)]
    schema = pa.schema([("pack", pa.int64()), ("place", pa.int64()), ("documents", pa.binary()), ("count", pa.int64())])

    def bound(order, size):
        table = pa.Table.from_pylist([dict(zip(schema.names, rows[i], strict=True)) for i in order], schema)
        return [b.to_pylist() for b in bind(iter(table.to_batches(max_chunksize=size)))]

    got = bound([3, 0, 2, 1, 6, 5, 4], 2)
    assert [x[0]["dids"] for x in got] == [[7, None], [8]] and [x[0]["known"] for x in got] == [[2, 1], [1]]
    assert got == bound(range(7), 7) == bound([1, 2, 3, 0, 5, 4, 6], 3)


def test_gradient_without_loss_is_the_same():
    shape, rng = gru.Shape(30, hidden=5, embedding=4), np.random.default_rng(3)
    vector = gru.initial(shape, rng.random(30) + 0.1)
    target, given = rng.integers(0, 30, (2, 6, 8))
    window = np.zeros((8, 5), gru.FLOAT), target, given, rng.random((6, 8)) < 0.2, np.full(6, 8)
    loss, want, last = gru.gradient(vector, shape, *window)
    none, got, same = gru.gradient(vector, shape, *window, with_loss=False)
    assert loss > 0 == none and (got == want).all() and (last == same).all()


def test_rows_of_windows_do_not_share_cache_lines():
    for columns in (1, 384, 1024, 6144, 8192, 12_288):
        x = gru._room(5, columns, gru.FLOAT)
        assert x.shape == (5, columns) and x.strides[0] % 4096 and x.strides[0] >= 4 * columns
        assert np.shares_memory(x, x.reshape(5, 1, -1))


def test_adam_by_blocks():
    rng = np.random.default_rng(4)
    size = gru.Adam.BLOCK + 70
    adam, got, want = gru.Adam(size, 0.01), np.zeros(size, gru.FLOAT), np.zeros(size)
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, 9):
        grad = rng.normal(0, 0.1, size)
        adam.update(got, grad.astype(gru.FLOAT))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        want -= 0.01 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-6)
    assert np.allclose(got, want, atol=1e-5)


def test_outputs_with_their_biases():
    shape, vector = model()
    p = gru.split(vector, shape)
    assert (p["classes"] == np.vstack((p["cw"], p["cb"]))).all() and (p["inside"] == np.vstack((p["uw"], p["ub"]))).all()
    assert np.shares_memory(p["inside"], vector)


def test_units_by_ending_are_spark_hashes(spark):
    words = [b"", b"a", b"ab", b"abc", b"\x00\xff\x80", "größe".encode(), b"of seven"]
    got = L._ending_units(pa.array([b"left out", *words], pa.binary()).slice(1)).tolist()
    rows = spark.createDataFrame([(w,) for w in words], "word binary")
    hashed = rows.selectExpr(f"pmod(xxhash64(substring(word, -3, 3)), {L.ENDING_UNITS}) AS unit").collect()
    assert got == [L.WORD_UNITS + r.unit for r in hashed]


def test_most_frequent_words(monkeypatch):
    monkeypatch.setattr(L, "WORD_UNITS", 3)
    words = pa.array([b"d", b"none", b"c", b"b", b"a", b""], pa.binary())
    assert L._most_frequent(words, np.array([1, 0, 1, 9, 1, 1])).tolist() == [3, 5, 4]
    assert L._most_frequent(words, np.zeros(6, np.int64)).tolist() == []


def test_words_are_counted_over_all_packs():
    """A pack is a row for each bucket of its words, not for each word."""
    packs = {4: {b"x": (0, 2), b"the": (1, 5), b"": (2, 3)}, 9: {b"the": (0, 4), b"new": (1, 0)}}
    rows = []
    for pack, words in packs.items():
        numbers, trained = (np.array([w[i] for w in words.values()], t) for i, t in ((0, np.int32), (1, np.int64)))
        rows.append({"pack": pack, "bucket": 7, "words": L._joined(numbers, trained, np.array([len(w) for w in words], np.int32), b"".join(words))})
    out = [r for b in L._counted(iter(pa.Table.from_pylist(rows, L._PACK_PA).to_batches(max_chunksize=1))) for r in b.to_pylist()]
    sums = next(L._merged(iter([L._rows(L._COUNTED_PA, **{k: [out[0][k]] for k in ("sums", "frequent")})]))).to_pylist()[0]
    mass, distinct = L._parted(sums["sums"], np.int64, np.int64)
    assert (mass.sum(), distinct.sum()) == (14, 3)
    place, counts, _, lengths, data = L._parted(sums["frequent"], np.int32, np.int64, np.int64, np.int32, np.uint8)
    assert L._from_lengths(lengths, data).to_pylist() == [b"the", b"", b"x"] and counts.tolist() == [9, 3, 2]
    seen = []
    bind = lambda batches: [seen.extend(b.to_pylist()) for b in batches]
    table = pa.Table.from_pylist([{"pack": r["pack"], "counted": r["counted"], "documents": None} for r in out[1:]] + [{"pack": 9, "counted": None, "documents": b"head"}])
    L._placed(place, bind)(iter(table.to_batches()))
    by = {(r["pack"], r["place"] // L.PLACES): (r["count"], r["place"] % L.PLACES) for r in seen if r["place"] >= 0}
    new = int(L._ending_units(pa.array([b"new"], pa.binary()))[0])
    assert by == {(4, 0): (2, 2), (4, 1): (9, 0), (4, 2): (3, 1), (9, 0): (9, 0), (9, 1): (0, new)}
    assert [r["documents"] for r in seen if r["place"] < 0] == [b"head"]


def test_a_pack_is_few_rows(spark, docs_of):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(40)]
    plain = docs_of(rows).select("doc_id", "text").coalesce(1)
    out = plain.mapInArrow(L._packs(L.PACK_BYTES), L._PACK).collect()
    assert len(out) <= L.BUCKETS + 1
    words = [w for r in out if r.words is not None for w in L._from_lengths(*L._parted(bytes(r.words), np.int32, np.int64, np.int32, np.uint8)[2:]).to_pylist()]
    assert len(words) == len(set(words)) == 16_001
