"""Token counts: how many pieces the best unigram segmentation of a text has.

Text is cut as a unigram tokenizer with a meta-space pre-tokenizer cuts it: spaces become
U+2581, one more is put in front unless there is one, and a new word starts at each. In a
word an Aho-Corasick automaton lists every vocabulary piece by where it ends; dynamic
programming carries the best score and the piece count to each end, and no path is kept.
Ties go to the piece that starts first, as scores are only replaced by greater ones from
left to right. A character without a piece of its own costs the least score less 10 and
becomes its UTF-8 bytes where the vocabulary has all of their pieces, else one unknown
piece for each run. Only words with such a character are traced back.

The vocabulary is a parameter: (piece, score) pairs, or a model file that is read on the
driver; its size is fixed. Counts agree with the tokenizers library's Unigram model.

Defined cases: null and empty texts have no pieces and score 0; a null doc_id is carried
through; repeated rows are counted alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def read_vocabulary(path: str = DEFAULT_MODEL) -> tuple[tuple[tuple[str, float], ...], int]:
    """((piece, score), ...) in id order, and the unknown piece's id, of a piece model file."""
    pieces, unknown = [], 0
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            fields = dict(_fields(value))
            if fields.get(3) == 2:  # the type of the unknown piece
                unknown = len(pieces)
            pieces.append((fields[1].decode(), struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0))
    return tuple(pieces), unknown


class Counter:
    """Counts for one vocabulary."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.pieces = {p for p, _ in vocabulary}
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a word.

        Matches come by where they end, longest first, so whatever a match stands on is final.
        """
        n = len(word)
        best, count, singles = [0.0] + [-math.inf] * n, [0] * (n + 1), 0
        for end, (size, score, unknown) in self.automaton.iter(word):
            start = end + 1 - size
            value = score + best[start]
            if value > best[end + 1]:
                best[end + 1], count[end + 1] = value, count[start] + 1
            if size == 1:
                singles += 1
            if unknown:
                break
        else:
            if singles == n:
                return count[n], best[n]
        return self._with_unknown(word)

    def _with_unknown(self, word: str) -> tuple[int, float]:
        """word() where a character may have no piece of its own."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        length = [0] * (n + 1)  # of the last piece; negative if it is unknown
        single = bytearray(n)
        by_end: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            by_end[end].append(match)
            if match[0] == 1:
                single[end] = 1
        odd = False
        for end in range(n):
            top = None
            for size, score, unknown in by_end[end]:
                value = score + best[end + 1 - size]
                if top is None or value > top:
                    top, count[end + 1], length[end + 1] = value, count[end + 1 - size] + 1, -size if unknown else size
            if not single[end]:
                value = self.unknown_score + best[end]
                if top is None or value > top:
                    top, count[end + 1], length[end + 1] = value, count[end] + 1, -1
            odd = odd or length[end + 1] < 0
            best[end + 1] = top
        return (self._traced(word, length) if odd else count[n]), best[n]

    def _traced(self, word: str, length: list[int]) -> int:
        """Pieces along the best path, runs of unknown ones as bytes or as one."""
        total, end, run = 0, len(word), ""
        while end > 0 or run:
            if end > 0 and length[end] < 0:
                run = word[end + length[end] : end] + run
                end += length[end]
                continue
            if run:
                bytes_ = run.encode()
                spelled = run not in self.pieces and all(f"<0x{b:02X}>" in self.pieces for b in bytes_)
                total += len(bytes_) if spelled else 1
                run = ""
            if end > 0:
                total += 1
                end -= length[end]
        return total

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        count, score = 0, 0.0
        cache = self.cache
        for w in text.split(SPACE)[1:]:
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                got = self.word(SPACE + w)
                if len(w) < 100:
                    cache[w] = got
            count += got[0]
            score += got[1]
        return count, score


@lru_cache(maxsize=2)
def _counter(vocabulary: tuple[tuple[str, float], ...], unknown: int) -> Counter:
    return Counter(vocabulary, unknown)


def counts(docs: DataFrame, vocabulary: tuple[tuple[str, float], ...], unknown: int = 0) -> DataFrame:
    """doc_id, n_tokens, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, unknown))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for dids, texts in C.rows_of(batches, "doc_id", "text"):
            got = [counter.text(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(dids, pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), C.text_col().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
