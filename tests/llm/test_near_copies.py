"""Near copies by five-word shingles against Jaccard similarity by brute force."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from tally.llm import common as C
from tally.llm import near_copies, near_dedup


def changed(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("chunk", [near_copies.CHUNK_SHINGLES, 500])
def test_near_copies(docs_of, chunk):
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts += [" ".join(changed(words, n, rng)) for n in (0, 0, 1, 2, 3, 4, 6, 9)]
    words = [f"v{i}" for i in range(150)]
    texts += [" ".join(changed(words, n % 4, rng)) for n in range(60)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute.roots(brute.linked([brute.shingles(t) for t in texts]), len(texts))
    classes = {}
    for r in near_copies.classes(docs_of(rows), chunk).collect():
        classes.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(min, classes.values())) == sorted(set(want))
    both = brute.groups(texts)
    got = near_dedup.apply(docs_of(rows), threshold=0.8)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(both))
    assert got.columns == docs_of(rows).columns


def test_group_of_unlike_and_like_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    # 1/3 of like pairs: each chain member drops the next 20 of the shared ones.
    sets = [np.unique(np.concatenate((base[20 * k : 20 * k + 200], rng.integers(0, 2**64, 1, dtype=np.uint64)))) for k in range(10)]
    sets += [rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range(40)]
    found = near_copies.group_links(list(range(50)), list(map(np.unique, sets)))
    assert sorted({x for p in found for x in p}) == list(range(10)) and len(found) == 9


def test_pipeline_leaves_no_near_copies(spark, docs_of):
    """Fingerprints at three bits leave some of these; the stage takes them."""
    rng = random.Random(6)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(len(rows) + k, " ".join(changed(words, k, rng))) for k in range(3)]
    docs = docs_of(rows)
    assert brute.linked([brute.shingles(r.text) for r in near_dedup.apply(docs).collect()])
    last = sorted((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "/root/testdata/sf0.001").collect())
    assert not brute.linked([brute.shingles(t) for _, t in last])
    assert [d for d, _ in last] == list(range(0, 90, 3))


def test_two_kinds_of_links_join_up(docs_of):
    """The first and the second are linked by shingles, the second and the third by fingerprints alone."""
    rng = random.Random(1)
    for _ in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts = [" ".join(words)]
        texts += [" ".join(changed(words, 1, rng))]
        texts += [" ".join(changed(texts[1].split(), 3, rng))]
        sets, fps = [brute.shingles(t) for t in texts], [brute.fingerprint(t) for t in texts]
        bits = lambda i, j: (fps[i] ^ fps[j]).bit_count()
        if (0, 1) in brute.linked(sets) and bits(0, 1) > 3 and bits(1, 2) <= 3 and bits(0, 2) > 3 and not {(1, 2), (0, 2)} & set(brute.linked(sets)):
            break
    else:
        texts = None
    if texts is None:
        pytest.skip("no such texts drawn")
    assert [r.doc_id for r in near_dedup.apply(docs_of(list(enumerate(texts))), threshold=0.8).collect()] == [0]
