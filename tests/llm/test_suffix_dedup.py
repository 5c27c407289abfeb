"""Repeated passages against a count of every window, and the suffix order against sorting."""

import random

import brute
import numpy as np
import pytest

from tally.llm import common as C
from tally.llm import suffix_dedup as S
from tally.llm.suffixes import Texts


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def passages():
    rng = random.Random(9)
    shared = [words(rng, 160) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 200)
            parts += [p[a : a + rng.randrange(300, 700)], words(rng, rng.randrange(0, 60))]
        rows.append((i, " ".join(parts)))
    edited = list(shared[0])
    for _ in range(30):  # near copies, cut and edited at random places
        e = list(edited)
        for _ in range(rng.randrange(1, 4)):
            e[rng.randrange(len(e))] = "#"
        rows.append((len(rows), "".join(e)))
    rows += [(100, "Thorble " * 150), (101, "Thorble " * 60), (102, "x" * 399), (103, "y" * 400), (104, "z" * 401), (105, "x" * 300), (106, None), (107, ""), (None, rows[0][1]), (0, rows[0][1]), (0, rows[1][1] + "!")]
    rows += [(200, shared[1] + " and " + shared[1])]
    return rows


@pytest.mark.parametrize("group_rows", [S.GROUP_ROWS, 3])
def test_against_every_window(docs_of, group_rows):
    rows = passages()
    want = brute.repeats(rows)
    got = sorted((tuple(r)[:5] for r in S.report(docs_of(rows), group_rows=group_rows).collect()), key=str)
    assert got == sorted(want, key=str)


def test_small_lengths_and_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 64)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 300)))) for i in range(30)]
    for i, t in rows:
        whole = S.anchors_of(t.encode(), 20, 8)
        monkeypatch.setattr(S, "_CHUNK", 1 << 19)
        assert all((a == b).all() for a, b in zip(whole, S.anchors_of(t.encode(), 20, 8)))
        monkeypatch.setattr(S, "_CHUNK", 64)
    got = sorted((tuple(r)[:5] for r in S.report(docs_of(rows), length=20, gram=8).collect()), key=str)
    assert got == sorted(brute.repeats(rows, 20), key=str)


def test_on_a_small_table(spark, sf):
    docs = C.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = S.report(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute.repeats(rows))
    check_passages(rows, got)


def check_passages(rows, got):
    """Whoever shares 51 words with another document has passages, whoever shares no 40 has none."""
    n = {(r.doc_id, r.n_bytes, r.kept_sha256): r.n_passages for r in got}
    found = {r.doc_id for r in got if r.n_passages}
    assert len(n) and {d for d, _ in brute.passages(rows, 51)} <= found <= {d for d, _ in brute.passages(rows, 40)}
    return found


def test_passages(docs_of):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [text(n) for n in (39, 45, 51, 51, 60, 200)]
    rows = [(i, f"{text(rng.randrange(0, 90))} {p}\n{text(rng.randrange(0, 90))}") for i, p in enumerate(shared * 3)]
    rows += [(100, "again " * 300), (101, text(40)), (102, None), (103, text(51))]
    rows += [(104, rows[-1][1]), (105, "  " + rows[-1][1] + "\n"), (106, text(30) + " " + rows[-1][1][:200]), (None, text(70))]
    found = check_passages(rows, S.report(docs_of(rows)).collect())
    assert not found & {0, 6, 12, 100, 101, 102, None} and {103, 104, 105} <= found


def test_nothing(docs_of):
    assert S.report(docs_of([])).collect() == []


def test_apply(docs_of):
    rows = passages()
    docs = docs_of(rows)
    out = S.apply(docs)
    assert out.columns == docs.columns
    want = {d: x for d, *x in brute.repeats(rows)}
    for r in out.collect():
        if r.doc_id in (100, 105, 107, 200):
            assert brute.sha(r.text or "") == want[r.doc_id][-1]


def test_suffix_order():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    marks = np.array([rng.randrange(0, len(t) + 1) for t in texts])
    size = np.array([1, 2, 3, 50, 100, 144])
    first = np.cumsum(size) - size
    t = Texts(texts, marks)
    for forward in (True, False):
        key = (lambda i: texts[i][marks[i] :]) if forward else (lambda i: texts[i][: marks[i]][::-1])
        order = t.order(first, size, forward)
        for f, n in zip(first, size):
            got = [key(i) for i in order[f : f + n]]
            assert got == sorted(got) and sorted(order[f : f + n]) == list(range(f, f + n))
