"""LM scoring: the log-likelihood of whole documents under a gated recurrent model.

Documents are read once into packs: token numbers of about PACK_BYTES of text, and the
pack's distinct words with their training counts, dealt by hash into BUCKETS. Each bucket's words
are summed over all packs, and each pack gets back the totals of its own words, so no dictionary
of the corpus is ever held, but for one bucket's. Words travel as one row for a pack and bucket.
The most frequent words are units of the model; every other word belongs to the unit of its
ending, and inside it has its share of the training counts, so the model is a distribution
over all words. Training averages weights: in each round every task trains from the same
weights on its share of the training documents, and a tree of means joins what they learnt.

Defined cases: a null text is empty, its only token the end; a null doc_id is not held out;
repeated rows count as often as given; without training documents every word is unknown;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import gru

FOLDS = 10
ADDED = 0.1
PACK_BYTES = 12 << 20
#: Units of single words, and of words by their ending.
WORD_UNITS = 1200
ENDING_UNITS = 400
#: More than there are units: a word's number in its pack and its unit are number * PLACES + unit.
PLACES = 1 << 16
#: A round trains on every STRIDE-th training document, another one each round: as many rounds use each once.
STRIDE = 2
ROUNDS = STRIDE
END = b""
#: Parts that words are counted in, each by itself.
BUCKETS = 512


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


_PACK = "pack long, bucket int, words binary, documents binary"
_PACK_PA = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("documents", pa.binary())])


def _rows(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    """Rows with the columns given and nulls elsewhere."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _joined(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays end to end, each after its size in bytes."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return b"".join(y for x in parts for y in (np.int64(len(x)).tobytes(), x))


def _parted(data: bytes, *kinds: type[np.generic]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _spelt(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts and the last one ends, all bytes) of words without nulls."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _from_lengths(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ending_units(words: pa.Array) -> np.ndarray:
    """Each word's unit if it has none of its own: XXH64 (seed 42) of its last three bytes."""
    at, data = _spelt(words)
    ends, n = at[1:].astype(np.int64), np.minimum(np.diff(at), 3)
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.uint64(42) + five + n.astype(np.uint64)
    for back in (3, 2, 1):
        has = n >= back
        own = h[has] ^ (data[ends[has] - back].astype(np.uint64) * five)
        h[has] = ((own << np.uint64(11)) | (own >> np.uint64(53))) * one
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    h ^= h >> np.uint64(32)
    return WORD_UNITS + (h.view(np.int64) % ENDING_UNITS)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, each byte of them in a plane of its own: the high ones are nearly all zero."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return np.int64(planes.size).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, kind: type[np.generic]) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(data[8:], n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(dids: list[int | None], sizes: list[int], tokens: np.ndarray) -> bytes:
    """A pack's documents as bytes: how many, their ids and which are null, token counts and token numbers."""
    ids, null = np.array([d or 0 for d in dids], np.int64), np.array([d is None for d in dids])
    return b"".join((np.int64(len(dids)).tobytes(), ids.tobytes(), np.array(sizes, np.int32).tobytes(), null.tobytes(), _squeezed(tokens)))


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, null = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, bool, n, 8 + 12 * n)
    return pa.array(ids, mask=null), np.frombuffer(data, np.int32, n, 8 + 8 * n), _restored(data[8 + 13 * n :], np.uint32)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, each text's followed by END; how many each has, with END)."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # What follows a last space is the empty word; an empty text is that word alone.
    closed = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), trimmed, pc.binary_join_element_wise(trimmed, "", " "))
    words = pc.ascii_split_whitespace(closed)
    return words.flatten().cast(pa.binary()), pc.list_value_length(words).to_numpy()


def _packs(pack_bytes: int):
    """One row with the documents of each pack, and one for each bucket of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        parts, dids, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pack = base | made
            # Every part gets the numbers of one dictionary, that of the pack.
            coded = pa.chunked_array(parts).dictionary_encode()
            ids = np.concatenate([x.indices.to_numpy() for x in coded.chunks]).astype(np.uint32)
            own = coded.chunk(0).dictionary
            learnt = np.repeat([not held_out(d) for d in dids], sizes)
            trained = np.bincount(ids[learnt], minlength=len(own))
            yield _rows(_PACK_PA, pack=[pack], documents=[_packed(dids, sizes, ids)])
            hashed = [np.fromiter(map(zlib.crc32, own.slice(a, 20_000).to_numpy(zero_copy_only=False)), np.uint32) for a in range(0, len(own), 20_000)]
            bucket = (np.concatenate(hashed) % BUCKETS).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            (at, data), bucket = _spelt(own.take(pa.array(order))), bucket[order]
            numbers, trained, lengths = order.astype(np.int32), trained[order], np.diff(at)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            for i in range(0, len(edges) - 1, 64):
                spans = list(zip(edges[i : i + 64], edges[i + 1 : i + 65], strict=False))
                words = [_joined(numbers[a:b], trained[a:b], lengths[a:b], data[at[a] : at[b]]) for a, b in spans]
                yield _rows(_PACK_PA, pack=[pack] * len(spans), bucket=[int(bucket[a]) for a, _ in spans], words=words)

        for b in batches:
            ids, lengths = b.column("doc_id").to_pylist(), pc.binary_length(b.column("text")).to_numpy().astype(np.int64)
            words, counts = _words(b.column("text"))
            edges, at = np.concatenate(([0], np.cumsum(counts))), 0
            while at < len(ids):
                reach = held + np.cumsum(lengths[at:])
                stop = at + min(int(np.searchsorted(reach, pack_bytes)) + 1, len(reach))
                parts.append(words.slice(edges[at], edges[stop] - edges[at]))
                dids += ids[at:stop]
                sizes += counts[at:stop].tolist()
                held, at = int(reach[stop - at - 1]), stop
                if held >= pack_bytes:
                    yield from flush()
                    made += 1
                    parts, dids, sizes, held = [], [], [], 0
        if dids:
            yield from flush()

    return run


_COUNTED = "pack long, counted binary, sums binary, frequent binary"
_COUNTED_PA = pa.schema([("pack", pa.int64()), ("counted", pa.binary()), ("sums", pa.binary()), ("frequent", pa.binary())])


def _most_frequent(words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Which WORD_UNITS words (or all) occur most, the smaller word first where counts are equal; none that never occurs."""
    found = np.flatnonzero(counts > 0)
    if len(found) > WORD_UNITS:
        least = np.partition(counts[found], -WORD_UNITS)[-WORD_UNITS]
        found = found[counts[found] >= least]
    spelt = pa.table({"count": pa.array(counts[found]), "word": words.take(pa.array(found))})
    return found[pc.sort_indices(spelt, [("count", "descending"), ("word", "ascending")]).to_numpy()[:WORD_UNITS]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket. For each a row with its sums by ending and its most frequent words, and one for each pack in
    it: its words' numbers, counts, units by ending, and places among all buckets' most frequent words or -1."""

    def counted(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        pieces = [_parted(x, np.int32, np.int64, np.int32, np.uint8) for _, x in rows]
        coded = pa.chunked_array([_from_lengths(lengths, data) for _, _, lengths, data in pieces]).dictionary_encode()
        own, ids = coded.chunk(0).dictionary, [x.indices.to_numpy() for x in coded.chunks]
        counts = np.zeros(len(own), np.int64)
        for i, (_, trained, _, _) in zip(ids, pieces, strict=True):
            # A pack has each word once.
            counts[i] += trained
        units, place = _ending_units(own), np.full(len(own), -1, np.int32)
        top = _most_frequent(own, counts)
        place[top] = bucket * WORD_UNITS + np.arange(len(top))
        by = units - WORD_UNITS
        mass = np.zeros(ENDING_UNITS, np.int64)
        np.add.at(mass, by, counts)
        at, data = _spelt(own.take(pa.array(top)))
        sums = _joined(mass, np.bincount(by[counts > 0], minlength=ENDING_UNITS).astype(np.int64))
        yield _rows(_COUNTED_PA, sums=[sums], frequent=[_joined(place[top], counts[top], units[top], np.diff(at), data[: at[-1]])])
        units = units.astype(np.uint16)
        for k in range(0, len(rows), 64):
            of = range(k, min(k + 64, len(rows)))
            yield _rows(_COUNTED_PA, pack=[rows[j][0] for j in of], counted=[_joined(pieces[j][0], counts[ids[j]], units[ids[j]], place[ids[j]]) for j in of])

    bucket, rows = None, []
    for b in batches:
        for own, *row in zip(*(b.column(n).to_pylist() for n in ("bucket", "pack", "words")), strict=True):
            if own != bucket and rows:
                yield from counted(bucket, rows)
                rows = []
            bucket = own
            rows.append(row)
    if rows:
        yield from counted(bucket, rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All buckets' sums and the most frequent words of them all, in one row."""
    sums, frequent = [], []
    for b in batches:
        sums += [_parted(x, np.int64, np.int64) for x in b.column("sums").to_pylist()]
        frequent += [_parted(x, np.int32, np.int64, np.int64, np.int32, np.uint8) for x in b.column("frequent").to_pylist()]
    if sums:
        place, counts, units, lengths, data = map(np.concatenate, zip(*frequent, strict=True))
        words = _from_lengths(lengths, data)
        top = _most_frequent(words, counts)
        at, data = _spelt(words.take(pa.array(top)))
        mass, distinct = (np.sum(x, axis=0) for x in zip(*sums, strict=True))
        yield _rows(_COUNTED_PA, sums=[_joined(mass, distinct)], frequent=[_joined(place[top], counts[top], units[top], np.diff(at), data[: at[-1]])])


def _placed(places: np.ndarray, bind):
    """A pack's rows as bind takes them: one for each word with its unit, that of its own if its place is among places."""
    order = np.argsort(places)
    held = np.append(places[order], np.iinfo(np.int32).max)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pack", "place", "documents", "count"]
        for b in batches:
            for pack, counted, documents in zip(*(b.column(n).to_pylist() for n in ("pack", "counted", "documents")), strict=True):
                if counted is None:
                    place, count, head = np.array([-1]), np.array([0]), pa.array([documents], pa.binary())
                else:
                    numbers, count, units, at = _parted(counted, np.int32, np.int64, np.uint16, np.int32)
                    found = np.searchsorted(held, at)
                    place = numbers.astype(np.int64) * PLACES + np.where(held[found] == at, np.append(order, 0)[found], units)
                    head = pa.nulls(len(place), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), pack)), pa.array(place), head, pa.array(count)], names=names)

    return lambda batches: bind(words(batches))


_BOUND = "dids array<long>, sizes array<int>, known array<int>, base array<double>, inside array<double>, units binary"
_BOUND_PA = pa.schema([("dids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("units", pa.binary())])


def _bind(total: int, distinct: int, ending_mass: dict[int, float]):
    """Gives each pack's tokens their units, and sums what doesn't need the model."""
    scale = math.log10(total + ADDED * (distinct + 1))
    mass = np.array([ending_mass.get(i, 1.0) for i in range(max(ending_mass, default=0) + 1)])

    def bound(head: bytes, place: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        number = place // PLACES
        words, unit = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        words[number], unit[number] = count, place % PLACES
        logs = np.log10(words + ADDED)
        inside = np.where(unit >= WORD_UNITS, logs - np.log10(mass[np.where(unit >= WORD_UNITS, unit, 0)]), 0.0)
        dids, sizes, tokens = _unpacked(head)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(doc, x[tokens], len(sizes)) for x in ((words > 0).astype(float), logs - scale, inside)]
        rows = [[dids.to_pylist()], [sizes], [sums[0].astype(np.int32)], [sums[1]], [sums[2]], [_squeezed(unit[tokens].astype(np.uint16))]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _BOUND_PA, strict=True)], schema=_BOUND_PA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pack, in any order: its words, and its documents at place -1."""
        pack = head = None
        parts = []
        for b in batches:
            packs, columns = b.column("pack").to_numpy(), [b.column(n).to_numpy(zero_copy_only=False) for n in ("place", "count")]
            edges = (np.flatnonzero(packs[1:] != packs[:-1]) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, len(packs)], strict=True):
                if end == start:
                    continue
                if packs[start] != pack:
                    if head is not None:
                        yield bound(head, *map(np.concatenate, zip(*parts, strict=True)))
                    pack, head, parts = packs[start], None, []
                word = columns[0][start:end] >= 0
                if not word.all():
                    head = b.column("documents")[start + int(np.argmin(word))].as_py()
                parts.append(tuple(c[start:end][word] for c in columns))
        if head is not None:
            yield bound(head, *map(np.concatenate, zip(*parts, strict=True)))

    return run


class Corpus:
    """A table of documents, bound: units for every token and the numbers that the base model needs."""

    def __init__(self, docs: DataFrame, pack_bytes: int = PACK_BYTES):
        spark = docs.sparkSession
        C.small_batches(spark)
        self.tokens = self.distinct = 0
        plain = docs.select(F.col("doc_id").cast("long"), C.text_col().alias("text"))
        packs = C.staged(plain.mapInArrow(_packs(pack_bytes), _PACK), "packs")
        words = packs.filter("bucket IS NOT NULL").select("pack", "bucket", "words")
        counts = C.staged(words.repartition(C.partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_counted, _COUNTED), "counts")
        # BUCKETS rows, of at most WORD_UNITS words each.
        merged = counts.filter("pack IS NULL").repartition(1).mapInArrow(_merged, _COUNTED).collect()
        top, places, rest, kinds = [], np.empty(0, np.int32), np.zeros(ENDING_UNITS, np.int64), np.zeros(ENDING_UNITS, np.int64)
        for r in merged:
            rest, kinds = (x.copy() for x in _parted(bytes(r.sums), np.int64, np.int64))
            self.tokens, self.distinct = int(rest.sum()), int(kinds.sum())
            places, own, units, lengths, data = _parted(bytes(r.frequent), np.int32, np.int64, np.int64, np.int32, np.uint8)
            top = list(zip(_from_lengths(lengths, data).to_pylist(), own.tolist(), strict=True))
            np.subtract.at(rest, units - WORD_UNITS, own)
            np.subtract.at(kinds, units - WORD_UNITS, 1)
        ending_mass = {WORD_UNITS + i: float(rest[i] + kinds[i] * ADDED + ADDED) for i in range(ENDING_UNITS)}
        heads = packs.filter("bucket IS NULL").select("pack", "documents")
        # A task binds about one pack, however many there are.
        tasks = max(C.partitions(spark), heads.select("pack").count())
        both = heads.unionByName(counts.filter("pack IS NOT NULL").select("pack", "counted"), allowMissingColumns=True).repartition(tasks, "pack").sortWithinPartitions("pack")
        self.bound = C.staged(both.mapInArrow(_placed(places, _bind(self.tokens, self.distinct, ending_mass)), _BOUND), "bound")
        mass = np.full(WORD_UNITS + ENDING_UNITS, 1e-9)
        mass[: len(top)] = [count + ADDED for _, count in top]
        mass[WORD_UNITS:] = [ending_mass[WORD_UNITS + i] for i in range(ENDING_UNITS)]
        # The model numbers units by frequency.
        order = np.argsort(-mass, kind="stable")
        self.rank = np.empty(len(mass), np.int64)
        self.rank[order] = np.arange(len(mass))
        self.mass = mass[order]
        self.end = int(self.rank[next((i for i, (word, _) in enumerate(top) if word == END), WORD_UNITS)])

    def shape(self) -> gru.Shape:
        return gru.Shape(len(self.mass))

    def documents_of(self, batch: pa.RecordBatch, i: int) -> tuple[list[int], list[np.ndarray]]:
        return split_documents(batch, i, self.rank)


def split_documents(batch: pa.RecordBatch, i: int, rank: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Ids and units of the documents of a bound pack."""
    units = rank[_restored(batch.column("units")[i].as_py(), np.uint16)]
    sizes = batch.column("sizes")[i].values.to_numpy()
    return batch.column("dids")[i].as_py(), np.split(units, np.cumsum(sizes)[:-1])


_WEIGHTS = "tokens long, weights binary"


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for b in batches:
        for n, w in zip(b.column("tokens").to_pylist(), b.column("weights").to_pylist(), strict=True):
            part = np.frombuffer(w, gru.FLOAT).astype(np.float64) * n
            total, tokens = part if total is None else total + part, tokens + n
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(gru.FLOAT).tobytes()], pa.binary())], names=["tokens", "weights"])


def train(corpus: Corpus, stride: int = STRIDE, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Weights of a model trained on the corpus's training documents."""
    shape, end, rank = corpus.shape(), corpus.end, corpus.rank
    vector = gru.initial(shape, corpus.mass, seed)
    for turn in range(rounds):
        start = vector
        # Adam's first steps from averaged weights should be small ones.
        rate = gru.RATE / (1 + turn)

        def learn(batches, start=start, turn=turn, rate=rate):
            weights, tokens, adam = start, 0, gru.Adam(len(start), rate)
            for b in batches:
                for i in range(b.num_rows):
                    ids, docs = split_documents(b, i, rank)
                    mine = [d for x, d in zip(ids, docs, strict=True) if not held_out(x) and zlib.crc32(str(x).encode(), 17) % stride == turn % stride]
                    weights = gru.train(weights, shape, mine, end, adam)
                    tokens += sum(map(len, mine))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["tokens", "weights"])

        learnt = corpus.bound.select("dids", "sizes", "units").mapInArrow(learn, _WEIGHTS)
        # Means of about as many weights as there are means: the driver gets the square root of the number of tasks.
        groups = max(1, math.isqrt(C.partitions(corpus.bound.sparkSession)))
        means = learnt.repartition(groups).mapInArrow(_mean, _WEIGHTS).collect()
        if means:
            total = sum(r.tokens for r in means)
            vector = sum(np.frombuffer(r.weights, gru.FLOAT) * gru.FLOAT(r.tokens / total) for r in means).astype(gru.FLOAT)
    return vector


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(corpus: Corpus, vector: np.ndarray) -> DataFrame:
    """_SCORE of every document of the corpus."""
    shape, end, rank, tokens = corpus.shape(), corpus.end, corpus.rank, corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, docs = split_documents(b, i, rank)
                own = gru.score(vector, shape, docs, end) / math.log(10)
                inside, base = (b.column(k)[i].values.to_numpy() for k in ("inside", "base"))
                known = b.column("known")[i].values.to_numpy()
                n = len(ids)
                columns = [ids, [held_out(x) for x in ids], [len(d) for d in docs], known.astype(np.int64), [tokens] * n, base, own + inside]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCORE.split(", ")])

    return corpus.bound.mapInArrow(run, _SCORE)


def report(docs: DataFrame, stride: int = STRIDE, rounds: int = ROUNDS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; the model learns from those not held out."""
    corpus = Corpus(docs, pack_bytes)
    return scores(corpus, train(corpus, stride, rounds))
