"""Suffix-array dedup: bytes inside a 400-byte string that also starts elsewhere are removed.

Every window of LENGTH bytes has an anchor, the leftmost smallest of its GRAM-byte hashes;
equal windows have equal anchors at equal offsets, so only anchors are dealt out, about one
for 137 bytes. Anchors whose gram occurs once are done. The others send the text around
them once for each distinct context, grouped by gram. A group is sorted by what follows the
anchors and by what precedes them: a hash-compared suffix sort, whose neighbours bound how
far each context is shared to either side. A pair of neighbours shared over LENGTH bytes
settles the windows between; windows that the bounds allow but no neighbour settles are
compared as pieces of that offset. Every claim is verified on the bytes. Groups of over
GROUP_ROWS contexts compare their windows as hashed rows of a shuffle instead, which needs
no group in one place. Equal texts are compared once and lose everything.

Passages of over PASSAGE_WORDS words that other documents have as well are counted beside
the bytes, as many are shorter than LENGTH. Of each PASSAGE_WORDS + 1 words in a row the
run of PASSAGE_GRAM with the smallest hash stands for all of them, so two documents with
such a passage have one of these runs in common, and two that share no PASSAGE_GRAM words
have none.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing, and neither does a
window that is nowhere else; repeated rows are copies of one another, as are rows that share
a doc_id; a null doc_id is carried through; an empty table gives no rows; other columns are
ignored, or passed on by ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import word_hashes
from .suffixes import Texts, powers, prefix_hashes

LENGTH = 400
GRAM = 128
PASSAGE_WORDS = 50
#: Words that passages are found by.
PASSAGE_GRAM = 40
#: Contexts of one gram that a task sorts.
GROUP_ROWS = 20_000
#: Contexts that a task sorts at once.
BATCH_ROWS = 2_000
#: Windows that a task compares at once.
WINDOWS = 200_000
_CHUNK = 1 << 19
_BITS = 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, smallest offset, largest offset) of each anchor; offsets are from the starts of its windows."""
    n, span = len(text) - length + 1, length - gram + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    data = np.frombuffer(text, np.uint8)
    up, down = powers(1 << min(_CHUNK + length, len(text)).bit_length())
    at = np.empty(n, np.int64)
    hashes: dict[str, list] = {"h": []}
    for a in range(0, n, _CHUNK):
        windows = min(_CHUNK, n - a)
        part = data[a : a + windows + length - 1]
        prefix = prefix_hashes(part, up)
        grams = len(part) - gram + 1
        h = _mixed((prefix[gram:] - prefix[:grams]) * down[:grams])
        hashes["h"].append(h[:windows] if a + windows < n else h)
        # The position below the hash: the smallest of a window is its leftmost smallest gram.
        key = (h >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[:windows], key[span - width : span - width + windows])
        at[a : a + windows] = a + (key & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    h = np.concatenate(hashes["h"])
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    at = at[first]
    return h[at].view(np.int64), at, at - last, at - first


_ANCHOR = "g long, did long, k1 long, k2 long, low int, high int, places binary, n int"


def _anchors(length: int, gram: int):
    """Anchors of one text that have gram and offsets in common are one row with all their positions: periodic text has many."""
    schema = pa.schema([("g", pa.int64()), ("did", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("places", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dids, k1s, k2s, texts in C.rows_of(batches, "did", "k1", "k2", "text"):
            parts: list[list] = [[] for _ in schema]
            for did, k1, k2, text in zip(dids, k1s, k2s, texts, strict=True):
                g, at, low, high = anchors_of(text, length, gram)
                order = np.lexsort((at, high, low, g))
                g, low, high = g[order], low[order], high[order]
                first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(g) else np.zeros(0, int)
                end = np.append(first[1:], len(g)) if len(g) else first
                raw = at[order].astype(np.int32).tobytes()
                places = [raw[4 * x : 4 * y] for x, y in zip(first.tolist(), end.tolist(), strict=True)]
                k = len(first)
                for column, values in zip(parts, (g[first], [did] * k, [k1] * k, [k2] * k, low[first], high[first], places, end - first), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, schema, strict=True)], schema=schema)

    return run


_CONTEXT = "g long, c1 long, c2 long, context binary, k1 long, k2 long, low int, high int, places binary, n int"
_CONTEXT_PA = pa.schema([("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("context", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("places", pa.binary()), ("n", pa.int32())])
_EMIT_ROWS = 2_000


def _contexts(length: int):
    """Cuts the text around each wanted anchor; c1 and c2 name the context by its bytes and offsets."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(_CONTEXT_PA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTEXT_PA, strict=True)], schema=_CONTEXT_PA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                k1, k2, text = (b.column(n)[i].as_py() for n in ("k1", "k2", "text"))
                text, wanted = text.encode(), b.column("wanted")[i].values
                for g, low, high, places in zip(*(wanted.field(k).to_pylist() for k in range(4)), strict=True):
                    found: dict[bytes, list[int]] = {}
                    pieces: dict[bytes, bytes] = {}
                    for at in np.frombuffer(places, np.int32).tolist():
                        piece = text[at - high : at - low + length]
                        name = xxhash.xxh3_128_digest(piece, low << 10 | high)
                        found.setdefault(name, []).append(at)
                        pieces.setdefault(name, piece)
                    for name, at in found.items():
                        c1, c2 = np.frombuffer(name, "<i8").tolist()
                        rows.append((g, c1, c2, pieces[name], k1, k2, low, high, np.array(at, np.int32).tobytes(), len(at)))
                    if len(rows) >= _EMIT_ROWS:
                        yield emit(rows)
                        rows = []
        yield emit(rows)

    return run


def shared_windows(contexts: list[bytes], low: np.ndarray, high: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of offsets (both ends in) whose windows another context of its group has.

    Group g has contexts first[g] to first[g] + size[g] - 1; a context has length - low bytes
    from its anchor on and high before it.
    """
    n = len(contexts)
    texts = Texts(contexts, high.astype(np.int64))
    group = np.repeat(np.arange(len(size)), size)
    most = {True: np.zeros(n, np.int64), False: np.zeros(n, np.int64)}
    pairs = []
    for forward in (True, False):
        order = texts.order(first, size, forward)
        a, b = order[:-1], order[1:]
        beside = group[a] == group[b]
        a, b = a[beside], b[beside]
        shared = texts.extension(a, b, forward)
        np.maximum.at(most[forward], a, shared)
        np.maximum.at(most[forward], b, shared)
        other = texts.extension(a, b, not forward)
        pairs.append((a, b, *((shared, other) if forward else (other, shared))))
    least, top = np.maximum(low, length - most[True]), np.minimum(high, most[False])
    sure: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, right, left in pairs:
        for i, j, r, s in zip(*(x[right + left >= length].tolist() for x in (a, b, right, left)), strict=True):
            x, y = int(texts.at[i]), int(texts.at[j])
            if texts.buffer[x - s : x + r] != texts.buffer[y - s : y + r]:
                raise ArithmeticError("two pieces of equal hash differ")
            for k in (i, j):
                if (lo := max(int(low[k]), length - r)) <= (hi := min(int(high[k]), s)):
                    sure[k].append((lo, hi))
    # Where the bounds allow more than the neighbours settle, windows meet at each offset.
    settled = np.array([sum(hi - lo + 1 for lo, hi in _merged(x)) for x in sure])
    allowed = np.maximum(0, top - least + 1)
    unsettled = np.unique(group[allowed > settled])
    open_ = np.flatnonzero(np.isin(group, unsettled) & (allowed > 0))
    # Windows of different offsets never meet, so offsets are taken a few at a time.
    step = max(1, WINDOWS // max(1, open_.size))
    for start in range(0, length if open_.size else 0, step):
        a, b = np.maximum(least[open_], start), np.minimum(top[open_], start + step - 1)
        count = np.maximum(0, b - a + 1)
        if not count.any():
            continue
        i = np.repeat(open_, count)
        offset = np.repeat(a, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        pieces = texts.piece(i, -offset, np.full(len(i), length))
        order = np.lexsort((pieces, offset, group[i]))
        same = (pieces[order][1:] == pieces[order][:-1]) & (offset[order][1:] == offset[order][:-1]) & (group[i][order][1:] == group[i][order][:-1])
        for a, b in zip(order[:-1][same].tolist(), order[1:][same].tolist(), strict=True):
            o = int(offset[a])
            x, y = int(texts.at[i[a]]) - o, int(texts.at[i[b]]) - o
            if texts.buffer[x : x + length] != texts.buffer[y : y + length]:
                raise ArithmeticError("two pieces of equal hash differ")
            sure[int(i[a])].append((o, o))
            sure[int(i[b])].append((o, o))
    return [_merged(x) for x in sure]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


_FOUND_PA = pa.schema([("kind", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
_FOUND = "kind int, c1 long, c2 long, low int, high int, w1 long, w2 long"
_SHARED, _WINDOW = 0, 1


def _compare(length: int, group_rows: int):
    """Over distinct contexts sorted by gram: shared offset ranges (kind 0); single windows of groups over group_rows (kind 1)."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(_FOUND_PA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_PA, strict=True)], schema=_FOUND_PA)

    def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(rows), 500):
            out = []
            for _, c1, c2, piece, low, high, again in rows[start : start + 500]:
                if again:
                    out.append((_SHARED, c1, c2, low, high, 0, 0))
                for o in range(low, high + 1):
                    w = np.frombuffer(xxhash.xxh3_128_digest(piece[high - o : high - o + length], o), "<i8")
                    out.append((_WINDOW, c1, c2, o, o, int(w[0]), int(w[1])))
            yield emit(out)

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        out = [(_SHARED, r[1], r[2], r[4], r[5], 0, 0) for r in rows if r[6]]  # the context itself is elsewhere too
        g = np.array([r[0] for r in rows])
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.concatenate((first, [len(rows)])))
        if (size > 1).any():
            meets = np.repeat(size > 1, size)
            rows = [r for r, m in zip(rows, meets.tolist(), strict=True) if m]
            size = size[size > 1]
            first = np.cumsum(size) - size
            low, high = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
            for r, ranges in zip(rows, shared_windows([r[3] for r in rows], low, high, first, size, length), strict=True):
                if not r[6]:
                    out += [(_SHARED, r[1], r[2], lo, hi, 0, 0) for lo, hi in ranges]
        return emit(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        over = None  # the gram of an oversized group that goes by
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("g", "c1", "c2", "context", "low", "high", "again")), strict=True):
                if over is not None and r[0] == over:
                    yield from windows([r])
                    continue
                over = None
                if group and r[0] != group[0][0]:
                    ready += group
                    group = []
                    if len(ready) >= BATCH_ROWS:
                        yield settle(ready)
                        ready = []
                group.append(r)
                if len(group) > group_rows:
                    yield from windows(group)
                    over, group = r[0], []
        if ready + group:
            yield settle(ready + group)

    return run


def passage_grams(text: bytes, over: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> np.ndarray:
    """Hashes of the runs of gram words that stand for the passages of a text, each once; none if it has no over + 1 words."""
    words = text.split()
    n, span = len(words) - over, over + 2 - gram
    if n < 1:
        return np.zeros(0, np.int64)
    up, down = powers(1 << len(words).bit_length())
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(_mixed(word_hashes(words)) * up[: len(words)], out=prefix[1:])
    least = _mixed((prefix[gram:] - prefix[:-gram]) * down[: len(words) - gram + 1])
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.unique(np.minimum(least[:n], least[span - width : span - width + n])).view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = pa.array([passage_grams(t) for t in C.binary(b.column("text"))], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), grams], names=["k1", "k2", "grams"])


def passages(docs: DataFrame) -> DataFrame:
    """(k1, k2, n_passages): for each text that has any, its passage grams that other documents have too."""
    C.small_batches(docs.sparkSession)
    rows = docs.select(*_keys(), C.text_col().alias("text")).mapInArrow(_grams, "k1 long, k2 long, grams array<long>").filter(F.size("grams") > 0)
    texts = C.staged(rows.groupBy("k1", "k2").agg(F.first("grams").alias("grams"), F.count("*").alias("n")), "passages")
    # Grams of equal texts are all shared; for the others it takes two texts.
    single = texts.select("k1", "k2", F.explode("grams").alias("gram"))
    shared = C.staged(single.groupBy("gram").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("gram"), "passages")
    met = single.join(shared, "gram").groupBy("k1", "k2").agg(F.count("*").alias("n_passages"))
    copies = texts.filter("n > 1").select("k1", "k2", F.size("grams").cast("long").alias("n_passages"))
    return met.unionByName(copies).groupBy("k1", "k2").agg(F.max("n_passages").alias("n_passages"))


def _keys() -> list:
    text = C.text_col()
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k1, k2, whole, ranges): for each text, by its two hashes, that loses something: all of it, or ranges of window offsets (low, high) at anchors (places), unmerged."""
    C.small_batches(docs.sparkSession)
    plain = docs.select(C.id_col().alias("did"), *_keys(), C.text_col().alias("text")).filter(F.octet_length("text") >= length)
    # Equal texts give one row for each anchor, that of the smallest id.
    anchors = C.staged(plain.mapInArrow(_anchors(length, gram), _ANCHOR).groupBy("g", "k1", "k2", "low", "high", "places", "n").agg(F.min("did").alias("did")), "anchors")
    # Written, so that the join deals both sides out anew and can split a gram that many texts have.
    again = C.staged(anchors.groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g"), "grams")
    wanted = anchors.join(again, "g").groupBy("did", "k1", "k2").agg(F.collect_list(F.struct("g", "low", "high", "places")).alias("wanted"))
    around = C.staged(plain.join(wanted, ["did", "k1", "k2"]).mapInArrow(_contexts(length), _CONTEXT), "contexts")
    place = F.struct("k1", "k2", "places")
    distinct = around.groupBy("g", "c1", "c2").agg(F.first("context").alias("context"), F.first("low").alias("low"), F.first("high").alias("high"), ((F.min(place) != F.max(place)) | (F.max("n") > 1)).alias("again"))
    found = C.staged(distinct.repartition(C.partitions(docs.sparkSession), "g").sortWithinPartitions("g").mapInArrow(_compare(length, group_rows), _FOUND), "shared")
    shared = found.filter(F.col("kind") == _SHARED).select("c1", "c2", "low", "high")
    single = found.filter(F.col("kind") == _WINDOW)
    if single.limit(1).count():
        name = F.struct("c1", "c2")
        twice = single.groupBy("w1", "w2").agg(F.min(name).alias("a"), F.max(name).alias("b")).filter("a != b").select("w1", "w2")
        shared = shared.unionByName(single.join(twice, ["w1", "w2"], "left_semi").select("c1", "c2", "low", "high"))
    places = around.select("c1", "c2", "k1", "k2", "places").distinct()
    ranges = places.join(shared, ["c1", "c2"]).select("k1", "k2", F.struct("places", "low", "high").alias("range"), F.lit(False).alias("whole"))
    copies = plain.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2", F.lit(None).cast("struct<places:binary,low:int,high:int>").alias("range"), F.lit(True).alias("whole"))
    return ranges.unionByName(copies).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.collect_list("range").alias("ranges"))


def removed(text: bytes, whole: bool | None, ranges: list | None, length: int = LENGTH) -> tuple[bytes, int, int]:
    """What remains, bytes removed, maximal removed runs."""
    if whole:
        return b"", len(text), 1 if text else 0
    runs = _merged([(at - r["high"], at - r["low"] + length - 1) for r in ranges or () for at in np.frombuffer(r["places"], np.int32).tolist()])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi + 1
    kept.append(text[at:])
    return b"".join(kept), sum(hi - lo + 1 for lo, hi in runs), len(runs)


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.binary(b.column("text"))
            got = [removed(t, w, r, length) for t, w, r in zip(texts, b.column("whole").to_pylist(), b.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [x[1] for x in got], [x[2] for x in got])), pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string()), b.column("n_passages")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), C.text_col().alias("text"))
    found = covered(docs, length, gram, group_rows).withColumn("n_passages", F.lit(0).cast("long"))
    also = passages(docs).select("k1", "k2", F.lit(None).cast(found.schema["whole"].dataType).alias("whole"), F.lit(None).cast(found.schema["ranges"].dataType).alias("ranges"), "n_passages")
    # One row for each text, so that the texts themselves are dealt out once.
    both = found.unionByName(also).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.first("ranges", ignorenulls=True).alias("ranges"), F.max("n_passages").alias("n_passages"))
    joined = plain.join(both, ["k1", "k2"], "left").select("doc_id", "text", "whole", "ranges", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def apply(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs with the columns they have, less the removed bytes; characters that lose a part of their bytes go."""

    @F.pandas_udf("string")
    def cut(text, whole, ranges):
        out = [None if w is None else removed(t.encode(), w, list(r), length)[0].decode("utf-8", "ignore") for t, w, r in zip(text, whole, ranges, strict=True)]
        return type(text)(out, index=text.index)

    k1, k2 = _keys()
    marked = C.wrapped(docs, k1=k1, k2=k2, text=C.text_col()).join(covered(docs, length, gram, group_rows), ["k1", "k2"], "left")
    text = F.when(F.col("whole").isNotNull(), cut(F.col("text"), F.col("whole"), F.col("ranges"))).otherwise(F.col("row").getField("text"))
    return C.unwrapped(marked.select("row", text.alias("text")), docs, text=F.col("text"))
