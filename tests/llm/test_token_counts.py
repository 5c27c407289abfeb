"""Token counts against the tokenizers library."""

import random

from tokenizers import Tokenizer, models, pre_tokenizers

from tally.llm import common as C
from tally.llm import token_counts as T


def library(vocabulary, unknown):
    t = Tokenizer(models.Unigram(list(vocabulary), unknown, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


TEXTS = ["", " ", " a", "a  b ", "▁x ▁▁y", "<unk> <s> <unk>é𝒳𝒳", "日本語 𝒳", "\t\n\n x", "a" * 5000, "   ", "é" * 300 + "\U0010ffff"]


def test_counts_of_a_model_file(spark, docs_of, sf):
    vocabulary, unknown = T.read_vocabulary()
    own = library(vocabulary, unknown)
    texts = [r.text for r in C.documents(spark, sf).select("text").collect()] + TEXTS
    got = {r.doc_id: r.n_tokens for r in T.counts(docs_of([*enumerate(texts), (None, None)]), vocabulary, unknown).collect()}
    assert got.pop(None) == 0
    want = own.encode_batch(texts, add_special_tokens=False)
    assert got == {i: len(w.ids) for i, w in enumerate(want)}


def test_ties_and_unknowns_of_random_vocabularies():
    rng = random.Random(8)
    for _ in range(40):
        pieces = {"▁": -1.0} if rng.random() < 0.5 else {}
        for _ in range(60):
            pieces["".join(rng.choice("▁abc") for _ in range(rng.randrange(1, 5)))] = float(-rng.randrange(1, 6))
        vocabulary = (("<unk>", 0.0), *pieces.items())
        own, counter = library(vocabulary, 0), T.Counter(vocabulary, 0)
        for _ in range(60):
            text = "".join(rng.choice("abcd  ") for _ in range(rng.randrange(0, 25)))
            assert counter.text(text)[0] == len(own.encode(text, add_special_tokens=False).ids), (text, vocabulary)


def test_nothing(docs_of):
    assert T.counts(docs_of([]), (("<unk>", 0.0), ("a", -1.0))).collect() == []
