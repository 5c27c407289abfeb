"""Near copies by shingles: documents whose sets of word 5-shingles have a Jaccard similarity of at least 0.8.

Only distinct sets are compared. A set's MinHash values, BANDS bands of BAND_ROWS, put it in
a bucket for each band; a pair at 0.8 shares none with probability under 1e-7. Buckets of
the same members are one bucket. Members are verified on their whole sets, breadth first: a
member meets those not yet reached, so a bucket gives fewer links than it has members. A
bucket over CHUNK_SHINGLES is cut into chunks, and chunks are compared two at a time. In
groups over SMALL, pairs whose MinHash values agree too seldom (at 0.8 with probability
under 1e-7) are not verified. Components come from rounds over the links.

It is what near_dedup links documents by when it is given a threshold: 0.8 is the least one
that the bands are made for.

Defined cases: a text of one to four words has one shingle, all of them; texts without words
are copies of each other; null ids, repeated rows, empty tables and other columns as in
near_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .decontaminate import _mix, shingle_hashes, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
#: MinHash values, of BANDS * BAND_ROWS, that a pair has in common at least.
AGREE = 72
CHUNK_SHINGLES = 1 << 20
SMALL = 24
_SEEDS, _FACTORS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.array([[0], [1]], np.uint64)
_PLACES = np.random.default_rng(12).integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = words_of(text)
    return np.unique(shingle_hashes(word_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def minhashes(own: np.ndarray) -> np.ndarray:
    least = np.full(len(_SEEDS), 2**64 - 1, np.uint64)
    for a in range(0, len(own), 256):
        h = (own[a : a + 256, None] ^ _SEEDS) * _FACTORS
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        np.minimum(least, h.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    return _mix(_mix(least.reshape(BANDS, BAND_ROWS) ^ _PLACES).sum(axis=1, dtype=np.uint64) + _PLACES[:, 0])


def node_of(own: np.ndarray) -> int:
    """Names a set."""
    return int(_mix(_mix(own + np.uint64(len(own))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


_MARKED = "did long, key long, doc_id long, node long, size long, bands array<long>"


def marked(docs: DataFrame) -> DataFrame:
    """_MARKED of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in C.binary(b.column("text"))]
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([bands(minhashes(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("did", "key", "doc_id")), *columns], names=["did", "key", "doc_id", "node", "size", "bands"])

    C.small_batches(docs.sparkSession)
    return C.keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, _MARKED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t).tobytes() for t in C.binary(b.column("text"))], pa.binary())], names=["node", "shingles"])


def group_links(nodes: list[int], sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what is connected within the group, fewer than its members."""
    sizes = np.array(list(map(len, sets)))
    values = np.stack([minhashes(s) for s in sets]) if len(sets) > SMALL else None
    left = np.ones(len(sets), bool)
    links = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier:
            i = frontier.pop()
            rest = np.flatnonzero(left)
            rest = rest[np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i])]
            if values is not None:
                rest = rest[(values[rest] == values[i]).sum(axis=1) >= AGREE]
            for j in rest.tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= threshold * (sizes[i] + sizes[j] - both):
                    left[j] = False
                    links.append((nodes[i], nodes[j]))
                    frontier.append(j)
    return links


def _links(threshold: float):
    """Over rows sorted by (band, a, b)."""

    def emit(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = group_links(nodes, sets, threshold)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("band", "a", "b")), strict=True)
            for key, node, data in zip(keys, batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if key != group:
                    if nodes:
                        yield emit(nodes, sets)
                    group, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
        if nodes:
            yield emit(nodes, sets)

    return run


def links(docs: DataFrame, rows: DataFrame, chunk_shingles: int = CHUNK_SHINGLES, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v): verified links between the nodes of rows (_MARKED of docs), enough to connect all that are connected."""
    spark = docs.sparkSession
    one = C.staged(rows.groupBy("node").agg(F.min(F.struct("did", "key", "size", "bands")).alias("r")).select("node", "r.*"), "nodes")
    of_band = one.select("node", "size", F.explode("bands").alias("band"))
    buckets = of_band.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("size").alias("shingles")).filter("n > 1")
    chosen = buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band"), F.max("shingles").alias("shingles"))
    chunks = F.ceil(F.greatest("shingles", F.lit(1)) / F.lit(chunk_shingles)).cast("long")
    members = of_band.join(chosen.select("band", chunks.alias("chunks")), "band").withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("chunks")))
    # With more than one chunk, each meets every other; its own rows meet there as well.
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: x != F.col("own"))))
    members = C.staged(members.select("band", "node", "own", other.alias("other")).select("band", "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")), "members")
    wanted = one.join(members.select("node").distinct(), "node", "left_semi").select("node", "did", "key")
    texts = C.keyed(docs).join(wanted, ["did", "key"]).select("node", "text").dropDuplicates(["node"])
    C.small_batches(spark)
    sets = C.staged(texts.mapInArrow(_sets, "node long, shingles binary"), "sets")
    dealt = members.join(sets, "node").repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    return C.staged(dealt.select("band", "a", "b", "node", "shingles").mapInArrow(_links(threshold), "u long, v long"), "links")


def classes(docs: DataFrame, chunk_shingles: int = CHUNK_SHINGLES, threshold: float = THRESHOLD) -> DataFrame:
    """(did, key, doc_id, root) of every row of docs; root names a set of the component."""
    rows = C.staged(marked(docs), "marked")
    roots = components(links(docs, rows, chunk_shingles, threshold)).select("node", "root")
    return rows.join(roots, "node", "left").select("did", "key", "doc_id", F.coalesce("root", "node").alias("root"))
