"""Properties of the pure functions, on generated texts."""

import re
import zlib

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tally.llm import decontaminate, line_dedup, lm_scoring, near_dedup, quality_rules, secret_scan, suffix_dedup, token_counts, trigrams

LETTERS = st.sampled_from(list("ab AB\n\t\r\x0b\x0c.é#$日") + [" ", "\xa0", "𝒳"])
TEXTS = st.text(LETTERS, max_size=120)
WORDS = st.lists(st.sampled_from(["a", "b", "ab", "é", "#x", "AB"]), max_size=60)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_statistics_and_fingerprints(text):
    assert quality_rules.statistics(text.encode())[0] == brute.stats(text)
    assert near_dedup.fingerprint(text.encode()) == brute.fingerprint(text)


@given(WORDS)
@settings(max_examples=200, deadline=None)
def test_repeated_words(words):
    assert quality_rules.repeated_words([w.encode() for w in words]) == brute.stats(" ".join(words))[4]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_line_keys(text):
    for line in text.split("\n"):
        assert line_dedup.line_key(line.encode()).decode() == brute.lower(line.strip(brute.WS))


@given(TEXTS, st.data())
@settings(max_examples=100, deadline=None)
def test_bitmaps_round_trip(text, data):
    n = text.count("\n") + 1
    keep = np.array(data.draw(st.lists(st.booleans(), min_size=n, max_size=n)))
    bitmap = zlib.compress(np.packbits(keep).tobytes(), 1)
    kept, lines, dropped = line_dedup.kept_text(text.encode(), bitmap)
    assert (line_dedup.unpack(bitmap, n) == keep).all() and lines == n and dropped == n - keep.sum()
    assert kept.decode() == "\n".join(x for x, k in zip(text.split("\n"), keep) if k)


@given(st.text(st.sampled_from("ab"), max_size=200), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_equal_anchors(text, before, after):
    """A window's anchor and offset don't depend on what stands around it."""
    length, gram = 20, 6

    def windows(data):
        g, at, low, high = suffix_dedup.anchors_of(data, length, gram)
        out = {}
        for h, a, lo, hi in zip(g.tolist(), at.tolist(), low.tolist(), high.tolist()):
            for o in range(lo, hi + 1):
                out[a - o] = (h, o)
        return out

    data = text.encode()
    whole, inner = windows(b"c" * before + data + b"d" * after), windows(data)
    assert set(inner) == set(range(max(0, len(data) - length + 1)))
    assert all(whole[p + before] == x for p, x in inner.items())


@given(st.text(st.sampled_from("pasword=:\"' tokenAKIA09secr_yi"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_trigram_queries_lose_no_match(text):
    for rule in secret_scan.RULES:
        if re.search(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.fold_case else 0)):
            assert all(any(all(t in text.lower() for t in a) for a in clause) for clause in rule.trigrams())


@given(st.sampled_from([r"abc|abd", r"(foo|bar)baz", r"ab?cde", r"x*abcd+", r"(a|b)(c|d)e+fgh", r"(?:abc){2,}d", r"[ab]{3}", r"(abcd)?", r"ab(c|de*)fgh"]), st.text(st.sampled_from("abcdefghorzx"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_trigrams_of_other_expressions(pattern, text):
    if re.search(pattern, text):
        assert all(any(all(t in text for t in a) for a in clause) for clause in trigrams.query(pattern))


@given(WORDS, st.lists(WORDS, min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_containment(doc, items):
    texts = [(i, " ".join(w)) for i, w in enumerate(items)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in texts])
    got = [(0, index.ids[i], n, m) for i, n, m in index.matches(" ".join(doc).encode(), 0.8)]
    assert sorted(got) == sorted(brute.contained([(0, " ".join(doc))], texts))


@given(st.text(st.sampled_from("▁ab c"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_counts_are_a_best_segmentation(text):
    """By trying every segmentation: the score is the best, and the count that of one such."""
    vocabulary = {"▁": -2.0, "a": -1.0, "b": -1.5, "c": -4.0, "ab": -2.0, "▁a": -2.0, "ba": -3.0}
    counter = token_counts.Counter((("<unk>", -1.0), *vocabulary.items()), 0)
    for word in {"▁" + w for w in text.replace(" ", "▁").split("▁")}:
        best = {0: (0.0, {0})}
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + vocabulary[word[s:end]], {n + 1 for n in best[s][1]}) for s in best if word[s:end] in vocabulary]
            top = max(w for w, _ in ways)
            best[end] = top, set().union(*(n for w, n in ways if w == top))
        count, score = counter.word(word)
        assert score == best[len(word)][0] and count in best[len(word)][1]


@given(st.integers(-(2**63), 2**63 - 2))
@settings(max_examples=100, deadline=None)
def test_held_out(doc_id):
    assert lm_scoring.held_out(doc_id) == (zlib.crc32(str(doc_id).encode()) % 10 == 0)
    assert not lm_scoring.held_out(None)
