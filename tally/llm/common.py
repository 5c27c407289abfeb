"""Shared helpers: input tables, staged tables, row keys and byte-level text rules.

Texts are handled as UTF-8 bytes in Python workers: ``bytes.lower`` changes A-Z
only and ``bytes.split`` splits at exactly the six characters 0x20, 0x09-0x0D.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A row without a doc_id counts as the document of the largest id.
NO_ID = 2**63 - 1
BATCH_ROWS = 250

_own_dir: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tally-"))
        at = f"file://{_own_dir[0]}"
    return f"{at.rstrip('/')}/tally-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application has staged. Call it once results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the documents that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_col(name: str = "doc_id") -> Column:
    """The id as a long, NO_ID for null: joins and orders treat null as one more, last document."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(text_col(name))


def keyed(df: DataFrame, *more: str) -> DataFrame:
    """(did, key, text, *more): whatever else df has, whose names may clash, is left out."""
    return df.select(id_col().alias("did"), text_key().alias("key"), text_col().alias("text"), *more)


def wrapped(docs: DataFrame, **marks: Column) -> DataFrame:
    """Every column of docs inside one, row, beside the marks, so that no name of a mark clashes with one of docs."""
    return docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in marks.items()))


def unwrapped(df: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of docs again, of a frame with their row; some with other values."""
    return df.select(*(instead.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mapped(docs: DataFrame, run) -> DataFrame:
    """docs through mapInArrow, with the columns they have; it takes no names with dots, so they go by number meanwhile."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Lists of the named columns for each batch; strings as bytes."""
    for b in batches:
        yield tuple(binary(b.column(n)) if pa.types.is_string(b.schema.field(n).type) else b.column(n).to_pylist() for n in names)


def utf8_length(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def as_text(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
