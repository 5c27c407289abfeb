"""JSON-lines journals and other inputs and outputs."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for a query's own files below spark.checkpoint.dir; where that is unset, and only on one machine, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}"
    return f"{at.rstrip('/')}/tally-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A journal; blank lines are skipped, and a missing path is an empty journal."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_torn(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(whole records, torn lines as text): a half-written line is told apart, not failed on."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    whole = parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    return whole, parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Files of their own for each write: writers never interleave, and an uncommitted write isn't seen."""
    df.write.mode("append").json(path)


def bulk_load(df: DataFrame, path: str, files: int, shard: str | None = None) -> None:
    """A parallel load in `files` files, in folders by shard if one is given, so that readers of one shard skip the others."""
    out = df.repartition(files) if shard is None else df.repartition(files, shard)
    (out.write if shard is None else out.write.partitionBy(shard)).mode("overwrite").parquet(path)


def jdbc_options(url: str, table: str, key: str, low: int, high: int, parts: int, **more: str) -> dict[str, str]:
    """What a read in `parts` ranges of a whole-number key asks of the JDBC source; rows below low or above high are in the outer ranges."""
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts), "pushDownPredicate": "true", "fetchsize": "10000"} | more


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **more: str) -> DataFrame:
    """A relational table in `parts` key ranges. Its driver has to be on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, low, high, parts, **more)).load()


def stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """New JSON files as a stream; max_files throttles a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def topic_options(servers: str, topic: str, max_offsets: int) -> dict[str, str]:
    """A topic from its start; offsets are the checkpoint's, so a batch counts as read when its effect is in."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "true"}


def kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000) -> DataFrame:
    """A keyed topic from its start. The connector has to be on the class path."""
    return spark.readStream.format("kafka").options(**topic_options(servers, topic, max_offsets)).load()


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as JSON, by a key whose messages share a partition of the topic and so keep their order."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def publish(df: DataFrame, key: str, servers: str, topic: str) -> None:
    """A batch of rows to a topic, by key, acknowledged by all replicas. The connector has to be on the class path."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
    keyed_messages(df, key).write.format("kafka").options(**options).save()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced whole by a rename."""
    fs, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if temporary.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(rename, 1)
    kinds[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(temporary), fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)), kinds)


class _Pointed:
    """Tables below a folder whose file CURRENT says what of them counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> dict | None:
        fs, p = _fs(self.spark, f"{self.root}/CURRENT")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])

    def _point(self, state: dict) -> None:
        _replace(self.spark, f"{self.root}/CURRENT", json.dumps(state))


class Versions(_Pointed):
    """Tables in version folders: readers see one version or the next."""

    def publish(self, tables: dict[str, DataFrame], **state) -> str:
        """Writes tables as the next version and flips to it."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        self._point(state | {"version": version})
        return version

    def read(self, name: str) -> DataFrame | None:
        state = self.state()
        at = state and f"{self.root}/{state['version']}/{name}"
        return self.spark.read.parquet(at) if at and exists(self.spark, at) else None


class Deltas(_Pointed):
    """Tables that only grow, a folder for each batch: a batch that is repeated after a crash replaces its own folder."""

    def batch(self) -> int:
        """The last batch that counts, -1 before the first."""
        state = self.state()
        return state["batch"] if state else -1

    def publish(self, tables: dict[str, DataFrame], batch: int) -> None:
        """Writes the batch's part of each table, then lets it count."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        self._point({"batch": batch})

    def read(self, name: str) -> DataFrame | None:
        """All parts that count."""
        last = self.batch()
        at = f"{self.root}/{name}"
        return self.spark.read.parquet(at).filter(F.col("batch") <= last).drop("batch") if last >= 0 and exists(self.spark, at) else None
