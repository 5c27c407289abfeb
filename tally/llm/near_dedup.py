"""SimHash near-dedup: documents whose 64-bit fingerprints differ in at most three bits.

Only distinct fingerprints are compared. Split into five bit blocks, two fingerprints
within three bits agree on two blocks at least, so each goes to the ten buckets that its
pairs of blocks name. In a bucket a pivot distance table (Hamming distances to reference
fingerprints) discards pairs: by the triangle inequality a pair within three bits differs
by at most three in every coordinate. Survivors are verified on the fingerprints. A bucket
gives one link for each member beyond a component's first, never all pairs; a bucket over
BUCKET_ROWS members is cut into chunks before it is dealt out, and chunks are compared two
at a time, each two in a group of their own. Components come from rounds over the links.

Defined cases: null or empty texts have fingerprint zero and are linked like any other; a
null doc_id is never a component's id, unless no other id is reachable; repeated rows come
back as often as they were given; an empty table gives no rows; other columns are ignored,
or passed on by ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import near_copies
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 12, dtype=np.uint64)
BUCKET_ROWS = 20_000

_CUTS = (0, 13, 26, 39, 52, 64)
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
MASKS = [a | b for a, b in combinations(_BLOCKS, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    count = n - SHINGLE + 1
    total = np.zeros(64, np.int64)
    for a in range(0, count, 1 << 15):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 15)], stops[a : a + (1 << 15)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(did, key, doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t)) for t in C.binary(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("key"), b.column("doc_id"), pa.array(fp, pa.int64())], names=["did", "key", "doc_id", "fp"])

    C.small_batches(docs.sparkSession)
    plain = C.keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return plain.mapInArrow(run, "did long, key long, doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints: a row for each of fps."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def _close(x: np.ndarray, xc: np.ndarray, y: np.ndarray, yc: np.ndarray) -> np.ndarray:
    """Whether each pair is within MAX_BITS: coordinates first, then the bits of the survivors."""
    near = np.abs(xc - yc).max(axis=1) <= MAX_BITS
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= MAX_BITS
    return near


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected within the bucket, fewer than its members.

    Breadth first: each reached member meets those not yet reached, in the order of the
    first coordinate, so a dense bucket costs about as many steps as it has members.
    """
    coords = pivot_table(fps)
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order]
    left = np.ones(len(fps), bool)
    links = []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier:
            i = frontier.pop()
            a, b = np.searchsorted(coords[:, 0], [coords[i, 0] - MAX_BITS, coords[i, 0] + MAX_BITS + 1])
            rest = a + np.flatnonzero(left[a:b])
            if len(rest):
                n = len(rest)
                got = rest[_close(np.broadcast_to(fps[i], n), np.broadcast_to(coords[i], (n, coords.shape[1])), fps[rest], coords[rest])]
                left[got] = False
                links += [(int(fps[i]), int(fps[j])) for j in got]
                frontier += got.tolist()
    return links


def _small_buckets(fps: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """Index pairs (i, i + k) within a run that are close; runs have at most `most` members."""
    out = []
    coords = pivot_table(fps)
    for k in range(1, most):
        i = np.flatnonzero(run[:-k] == run[k:])
        if not len(i):
            break
        near = _close(fps[i], coords[i], fps[i + k], coords[i + k])
        out.append(np.stack((i[near], i[near] + k), 1))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


_GROUP = ["bucket", "part", "a", "b"]
_SMALL = 24


def _links_of() -> Callable:
    """Links over rows sorted by (bucket, part, a, b, fp), a run of equal ones being a group."""

    def settle(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Whole runs."""
        new = np.ones(len(fps), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        some = (sizes[run] <= _SMALL) & (sizes[run] > 1)
        rows = []
        if some.any():
            f, r = fps[some], run[some]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            for i, j in _small_buckets(f, r, _SMALL).tolist():
                if (a := root(i)) != (b := root(j)):
                    parent[b] = a
                    rows.append((int(f[i]), int(f[j])))
        starts = np.flatnonzero(new)
        for k in np.flatnonzero(sizes > _SMALL):
            rows += bucket_links(fps[starts[k] : starts[k] + sizes[k]])
        columns = zip(*((_signed(u), _signed(v)) for u, v in rows), strict=True) if rows else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate((keys, np.stack([b.column(n).to_numpy().astype(np.int64) for n in _GROUP], 1)))
            fps = np.concatenate((fps, b.column("fp").to_numpy().view(np.uint64)))
            if (keys != keys[-1]).any():
                tail = len(fps) - int(np.argmin((keys[::-1] == keys[-1]).all(axis=1)))
                yield settle(keys[:tail], fps[:tail])
                keys, fps = keys[tail:], fps[tail:]
        if len(fps):
            yield settle(keys, fps)

    return run


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links between the fingerprints of distinct (fp long), enough to connect all that are connected."""
    spark = distinct.sparkSession
    distinct = C.staged(distinct.select("fp"), "distinct")
    masks = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(MASKS)))
    rows = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("m.bucket").alias("bucket"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("part"), "fp")
    # At most one in bucket_rows of the rows: buckets that no task should get as a whole.
    big = C.staged(rows.groupBy("bucket", "part").count().filter(F.col("count") > bucket_rows).select("bucket", "part", F.ceil(F.col("count") / bucket_rows).alias("chunks")), "buckets")
    if big.limit(1).count():
        chunks = F.coalesce("chunks", F.lit(1))
        marked = rows.join(big, ["bucket", "part"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), chunks))
        # Of a big bucket each two chunks meet in a group; a chunk's own rows meet there as well.
        others = F.filter(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda x: (x != F.col("own")) | (chunks == 1))
        each = marked.withColumn("other", F.explode(others))
        rows = each.select("bucket", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    else:
        rows = rows.select("bucket", "part", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp")
    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "fp")
    return C.staged(dealt.mapInArrow(_links_of(), "u long, v long"), "links")


def classes(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(did, key, doc_id, fp, root, component_id) of every row of docs; root is a fingerprint of the component."""
    marked = C.staged(fingerprints(docs), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bucket_rows)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp")


def report(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id for every row of docs."""
    return classes(docs, bucket_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_classes(docs: DataFrame, threshold: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(did, key, component_id) of every row of docs, linked by fingerprints or by five-word shingles in common.

    Documents that share threshold of their shingles are too many bits apart for a radius that
    tells fingerprints apart, so those links come from the shingle sets themselves. Both kinds
    of classes are joined where they share a document.
    """
    near = classes(docs, bucket_rows).select("did", "key", "doc_id", F.xxhash64(F.lit("fingerprint"), "root").alias("u"))
    alike = near_copies.classes(docs, threshold=threshold).select("did", "key", F.xxhash64(F.lit("shingles"), "root").alias("v")).distinct()
    both = C.staged(near.join(alike, ["did", "key"]), "classes")
    roots = components(both.select("u", "v").distinct()).select(F.col("node").alias("u"), "root")
    rooted = both.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("did", "key", "component_id")


def apply(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, threshold: float | None = None) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, of the smallest text key among repeated ids.

    With a threshold, five-word shingle sets of at least that Jaccard similarity are linked as well.
    """
    plain = docs.select("doc_id", "text")
    found = classes(plain, bucket_rows) if threshold is None else wide_classes(plain, threshold, bucket_rows)
    keep = found.filter(F.col("did") == F.coalesce("component_id", F.lit(C.NO_ID))).groupBy("component_id").agg(F.min(F.struct("did", "key")).alias("k")).select("k.did", "k.key")
    marked = C.wrapped(docs, did=C.id_col(), key=C.text_key())
    return C.unwrapped(marked.join(keep, ["did", "key"]).dropDuplicates(["did", "key"]), docs)
