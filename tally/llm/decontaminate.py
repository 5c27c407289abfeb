"""Benchmark decontamination: documents that contain a test item, whole or nearly.

Containment is the share of an item's distinct word 5-shingles (A-Z lower-cased) found in
the document. Documents are partitioned by size: one of up to 2^k distinct shingles gets
a one-permutation MinHash sketch of 2^(k+2) bins, so the sketch keeps its resolution for
short items inside very long documents, and each item is indexed under every size.
A bin that agrees makes the pair a candidate; candidates are verified by exact shingle
containment. Sketches have at least four bins a shingle, so a shingle loses its bin with
probability under 0.22 and an item of at least 16 shingles with 13 of them in the document
is missed with probability under 1e-8; items with fewer are indexed by all their shingles,
which misses nothing. Items are sent to the executors in blocks of bounded size, each
block against all documents.

Defined cases: null or empty items match nothing; an item of one to four words has one
shingle, all of them; null texts contain nothing; a null doc_id is carried through;
repeated rows and items give repeated rows and item ids once for each; empty tables give no
rows; other columns are ignored, or passed on by ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
THRESHOLD = 0.8
#: An item with fewer distinct shingles is indexed by all of them.
WHOLE_BELOW = 16
BINS_PER_SHINGLE = 4
#: Bytes of item text in a block.
BLOCK_BYTES = 8 << 20
_MAX_K = 40

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each window of size words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += _mix(hashes[k : k + n] + _MULT[k]) * _MULT[k]
    return _mix(total)


def sketch(distinct: np.ndarray, k: int) -> np.ndarray:
    """The smallest hash of each filled bin, out of 2^k * BINS_PER_SHINGLE: its bin is in it."""
    bins = distinct & np.uint64((BINS_PER_SHINGLE << k) - 1)
    rank = distinct >> np.uint64(8)
    order = np.lexsort((rank, bins))
    first = np.ones(len(order), bool)
    first[1:] = bins[order][1:] != bins[order][:-1]
    return distinct[order[first]]


def size_class(n: int) -> int:
    """The k of the size partition: n distinct shingles at most 2^k."""
    return max(0, int(n - 1).bit_length())


class ItemIndex:
    """Items of one block: shingles, and for each document size the sketch entries that point to them."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.sets, self.lengths = [], [], []
        for item, text in items:
            words = words_of(text or b"")
            if words:
                size = min(SHINGLE, len(words))
                self.ids.append(item)
                self.lengths.append(size)
                self.sets.append(np.unique(shingle_hashes(word_hashes(words), size)))
        self.short = sorted({n for n in self.lengths if n < SHINGLE})
        self._by_class: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def entries(self, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted sketch entries for documents of class k, and the item of each."""
        if (k, size) not in self._by_class:
            chosen = [(i, s) for i, s in enumerate(self.sets) if self.lengths[i] == size]
            parts = [(s if len(s) < WHOLE_BELOW else sketch(s, k), i) for i, s in chosen]
            values = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
            owners = np.concatenate([np.full(len(p), i) for p, i in parts]) if parts else np.zeros(0, int)
            order = np.argsort(values, kind="stable")
            self._by_class[k, size] = values[order], owners[order]
        return self._by_class[k, size]

    def matches(self, text: bytes, threshold: float) -> list[tuple[int, int, int]]:
        """(position of the item, its distinct shingles, how many the text has) for each item the text contains."""
        words = words_of(text)
        hashes = word_hashes(words)
        out = []
        for size in (*self.short, SHINGLE):
            if len(words) < size or not (own := np.unique(shingle_hashes(hashes, size))).size:
                continue
            k = size_class(len(own))
            values, owners = self.entries(k, size)
            if not len(values):
                continue
            # Short items are indexed by every shingle: their entries meet the whole set, the others the document's sketch.
            kept = sketch(own, k)
            candidates: set[int] = set()
            for probe, short in ((kept, False), (own, True)):
                lo, hi = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    candidates.update(i for i in owners[a:b].tolist() if (len(self.sets[i]) < WHOLE_BELOW) == short)
            for i in sorted(candidates):
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if shared >= threshold * len(self.sets[i]):
                    out.append((i, len(self.sets[i]), shared))
        return out


def blocks_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most block_bytes of text (or one item), streamed through the driver."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), C.text_col().cast("binary").alias("text")).toLocalIterator():
        if block and size + len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared: an item and a document that has at least threshold of its shingles."""
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    plain = docs.select(F.col("doc_id").cast("long"), C.text_col().alias("text"))
    C.small_batches(docs.sparkSession)

    def against(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block)
            for dids, texts in C.rows_of(batches, "doc_id", "text"):
                rows = [(d, index.ids[i], n, m) for d, t in zip(dids, texts, strict=True) for i, n, m in index.matches(t, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        return plain.mapInArrow(run, schema)

    parts = [against(b) for b in blocks_of(items, block_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def apply(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that contain no item."""
    at = docs.columns.index("text")
    C.small_batches(docs.sparkSession)

    def without(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t or b"", threshold) for t in C.binary(b.column(at))], pa.bool_()))

        return run

    for block in blocks_of(items, block_bytes):
        docs = C.mapped(docs, without(block))
    return docs


#: contained() in DuckDB's SQL, for the default threshold.
ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
im AS (SELECT q, item_id, w, least(5, len(w)) AS m FROM iw WHERE len(w) > 0),
ix AS (SELECT q, item_id, m, unnest(list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) AS s FROM im),
n AS (SELECT q, count(*) AS n FROM ix GROUP BY q),
dx AS (SELECT r, doc_id, m, unnest(list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) AS s FROM dw, (SELECT DISTINCT m FROM im) WHERE len(w) >= m)
SELECT any_value(dx.doc_id) AS doc_id, any_value(ix.item_id) AS item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM dx JOIN ix ON dx.m = ix.m AND dx.s = ix.s JOIN n ON n.q = ix.q GROUP BY r, ix.q HAVING count(*) >= 0.8 * any_value(n.n)"""
