"""Line dedup: a long line that several documents hold stays in one of them.

Lines become 128-bit hashes. The hashes are range-partitioned on (hash, document,
position), so that one very common line spreads over many partitions, sorted inside
each partition, and streamed: the first document of a run keeps the line. A run that
began in an earlier partition is settled by a table of at most two rows a partition.
What comes back is a compressed keep bitmap for each document that loses a line; text
is never sorted.

Defined cases: a null text is one empty line; a null doc_id is one more document, after
all others; rows that share a doc_id are one document for counting, and each loses its
own lines; an empty table gives no rows; other columns are ignored, or passed on by
``apply``, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS = 10
RANGES_A_FILE = 3

_LINES = "h1 long, h2 long, did long, key long, pos int, n int"
_LINES_PA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])
_DROPS = "kind int, " + _LINES
_DROPS_PA = pa.schema([("kind", pa.int32()), *_LINES_PA])
_SURE, _EARLIER, _TAIL = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(C.WHITESPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or C.utf8_length(key) >= least)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for dids, keys, texts in C.rows_of(batches, "did", "key", "text"):
            digests, counts, at, sizes = [], [], [], []
            for text in texts:
                lines = text.split(b"\n")
                before = len(at)
                for i, line in enumerate(lines):
                    if _long_enough(k := line_key(line), least):
                        digests.append(digest(k))
                        at.append(i)
                counts.append(len(at) - before)
                sizes.append(len(lines))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = [h[:, 0], h[:, 1], np.repeat(np.array(dids, np.int64), counts), np.repeat(np.array(keys, np.int64), counts), np.array(at, np.int32), np.repeat(np.array(sizes, np.int32), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_LINES_PA)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: lines after a run's first document are dropped; the first run may have begun earlier and is left open."""
    first = last = None
    owner = 0
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, did = (b.column(n).to_numpy() for n in ("h1", "h2", "did"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last
        if first is None:
            first = (h1[0], h2[0])
        run = np.cumsum(new) - 1
        owners = np.concatenate(([owner], did[new])) if not new[0] else did[new]
        run = run + (0 if new[0] else 1)
        owned = owners[run]
        kind = np.where((h1 == first[0]) & (h2 == first[1]), _EARLIER, _SURE).astype(np.int32)
        out = (kind == _EARLIER) | (did != owned)
        owner, last = int(owned[-1]), (h1[-1], h2[-1])
        if out.any():
            mask = pa.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(kind[out]), *(b.column(f.name).filter(mask) for f in _LINES_PA)], schema=_DROPS_PA)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((_TAIL, *map(int, last), owner, 0, 0, 0), _DROPS_PA, strict=True)], schema=_DROPS_PA)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for n, at in zip(b.column("n").to_pylist(), b.column("at").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("did"), b.column("key"), b.column("n").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["did", "key", "n_lines", "n_dropped", "keep_bitmap"])


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, key, n_lines, n_dropped, keep_bitmap) of each document that loses a line; all others keep every line."""
    spark = docs.sparkSession
    C.small_batches(spark)
    # Hashed once for the ranges' bounds and once to be dealt out, which takes less than a table of all lines.
    lines, tasks = C.keyed(docs).mapInArrow(_lines(min_chars), _LINES), C.partitions(spark)
    order = ["h1", "h2", "did", "key", "pos"]
    sorted_lines = lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # Few lines are dropped: three partitions to a file.
    found = C.staged(sorted_lines.mapInArrow(_first_occurrences, _DROPS).coalesce(-(-tasks // RANGES_A_FILE)), "line-drops")
    # At most one open run and one tail for each partition: a bound that holds at any size.
    owners = found.filter(F.col("kind") != _SURE).groupBy("h1", "h2").agg(F.min("did").alias("owner"))
    open_runs = found.filter(F.col("kind") == _EARLIER).join(F.broadcast(owners), ["h1", "h2"]).filter(F.col("did") != F.col("owner"))
    drops = found.filter(F.col("kind") == _SURE).select("did", "key", "pos", "n").unionByName(open_runs.select("did", "key", "pos", "n"))
    return drops.groupBy("did", "key").agg(F.max("n").alias("n"), F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "did long, key long, n_lines long, n_dropped long, keep_bitmap binary")


def _with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row, text, keep) of every row of docs; keep is null where every line stays."""
    marked = C.wrapped(docs, did=C.id_col(), key=C.text_key(), text=C.text_col())
    maps = keep_bitmaps(docs, min_chars).select("did", "key", F.col("keep_bitmap").alias("keep"))
    return marked.join(maps, ["did", "key"], "left").select("row", "text", "keep")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The remaining text, its lines before, and how many went."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = unpack(bitmap, len(lines))
    return b"\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int(len(lines) - keep.sum())


def digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_text(t, m) for t, m in zip(C.binary(b.column("text")), b.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long"), C.text_col().alias("text"))
    return _with_bitmaps(plain, min_chars).select("row.doc_id", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def apply(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the columns they have, less the dropped lines; n_chars follows the text where there is such a column."""

    @F.pandas_udf("string")
    def cut(text, keep):
        return text.where(keep.isna(), [x if k is None else kept_text(x.encode(), k)[0].decode() for x, k in zip(text, keep, strict=True)])

    lost = F.col("keep").isNotNull()
    found = _with_bitmaps(docs, min_chars).select("row", "keep", F.when(lost, cut(F.col("text"), F.col("keep"))).otherwise(F.col("row.text")).alias("text"))
    return C.unwrapped(found, docs, text=F.col("text"), n_chars=F.when(lost, F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None)


#: digests() in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, 9223372036854775807)) > 1),
f AS (SELECT k.doc_id, k.r, k.pos, k.line, o.key IS NOT NULL AND coalesce(k.doc_id, 9223372036854775807) <> o.owner AS dropped FROM k LEFT JOIN o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY r"""
