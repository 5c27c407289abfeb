"""Scalar expressions: names, hashes, routing keys, packed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of a packed identifier (milliseconds, 10 bits of worker, 12 bits of
# sequence), its epoch of 2024-01-01T00:00:00Z, and the odd factor of the scramble.
WORKER_BITS = 10
SEQ_BITS = 12
EPOCH_MS = 1_704_067_200_000
SCRAMBLE = 2654435761

MAX_WORKER, MAX_SEQ = (1 << WORKER_BITS) - 1, (1 << SEQ_BITS) - 1


def name_first(name: Column) -> Column:
    """All before the last space; the whole name without one."""
    cut = F.length(name) - F.length(name_last(name)) - 1
    return F.when(F.instr(name, " ") > 0, F.substring(name, F.lit(1), cut)).otherwise(name)


def name_last(name: Column) -> Column:
    """What follows the last space; empty without one."""
    return F.when(F.instr(name, " ") > 0, F.substring_index(name, " ", -1)).otherwise(F.when(name.isNotNull(), F.lit("")))


def name_composed(first: Column, last: Column) -> Column:
    """Both parts with a space between, empty ones skipped; null if both are null."""
    part = lambda c: F.when(c != "", c)
    return F.when(first.isNull() & last.isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws(" ", part(first), part(last)))


def shard_crc(key: Column, shards: int) -> Column:
    """CRC-32 of the key's decimal digits, modulo the number of shards."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(shards)).cast("int")


def shard_modulo(key: Column, shards: int) -> Column:
    return F.pmod(key, F.lit(shards)).cast("int")


def scrambled(rank: Column) -> Column:
    """A bijection of the numbers below 2^32 that spreads neighbours."""
    return (rank * F.lit(SCRAMBLE)).bitwiseAND(F.lit(0xFFFFFFFF))


def minute_of(index: Column, n: int | Column, minutes: int) -> Column:
    """The minute of an event by its place among n."""
    return F.least(F.floor(index * minutes / n), F.lit(minutes - 1).cast("long"))


def text_hash(*columns: Column) -> Column:
    """The first 32 bits of an MD5 over the columns joined by #, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def packed_id(ts_ms: Column, worker: Column, seq: Column) -> Column:
    return F.shiftleft(ts_ms.cast("long"), WORKER_BITS + SEQ_BITS).bitwiseOR(F.shiftleft(worker.cast("long"), SEQ_BITS)).bitwiseOR(seq.cast("long"))


def unpacked_id(packed: Column) -> dict[str, Column]:
    return {"ts_ms": F.shiftright(packed, WORKER_BITS + SEQ_BITS), "worker": F.shiftright(packed, SEQ_BITS).bitwiseAND(F.lit(MAX_WORKER)), "seq": packed.bitwiseAND(F.lit(MAX_SEQ))}


def uuid7(ts_ms: Column) -> Column:
    """A version-7 UUID: 48 bits of milliseconds, then random bits of a version-4 one."""
    random = F.uuid()
    stamp = F.lpad(F.lower(F.hex(ts_ms.cast("long"))), 12, "0")
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(random, 16, 21))


def edge_ngrams(word: Column, least: int = 2, most: int = 15) -> Column:
    """Prefixes of the lower-cased word from least to most characters."""
    low = F.lower(word)
    sizes = F.when(F.length(low) >= least, F.sequence(F.lit(least), F.least(F.lit(most), F.length(low)))).otherwise(F.array().cast("array<int>"))
    return F.transform(sizes, lambda n: F.substring(low, F.lit(1), n))


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a zoneless timestamp, read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")
