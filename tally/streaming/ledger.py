"""Streams whose effects happen once: dedupe, quarantine and state in tables that grow by batch.

Each batch writes what it adds, the ids it saw first and the sums it makes, to folders of its
own and lets them count last. Offsets are committed after that, so a crash in between repeats
a batch: it is skipped if it counts already, and replaces its own folders if not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import events as E
from ..operators.sequences import first_of
from ..sources.journals import Deltas, stream


class IdempotentLedger:
    """Balances by account from deliveries of (event_id, account_id, amount)."""

    def __init__(self, spark: SparkSession, root: str, quarantine: str | None = None):
        self.deltas, self.quarantine = Deltas(spark, root), quarantine
        #: Called at named points; tests raise here.
        self.hook: Callable[[str, int], None] = lambda point, batch: None

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch of raw messages (value)."""
        if number <= self.deltas.batch():
            return
        parsed = E.validated(batch).persist()
        try:
            if self.quarantine:
                parsed.filter("NOT ok").select("value").write.mode("overwrite").json(f"{self.quarantine}/batch={number}")
            new = first_of(parsed.filter("ok").select("event_id", "account_id", "amount"), "event_id", "account_id", "amount")
            seen = self.deltas.read("seen")
            if seen is not None:
                new = new.join(seen, "event_id", "left_anti")
            sums = new.groupBy("account_id").agg(F.sum("amount").alias("total"))
            self.hook("before", number)
            self.deltas.publish({"seen": new.select("event_id"), "sums": sums}, number)
            self.hook("after", number)
        finally:
            parsed.unpersist()

    def balances(self) -> DataFrame | None:
        sums = self.deltas.read("sums")
        return None if sums is None else sums.groupBy("account_id").agg(F.sum("total").cast("long").alias("total"))

    def run(self, path: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
        """Everything that the folder of JSON files holds; returns when it is applied."""
        schema = StructType().add("value", "string")
        source = self.deltas.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).text(path)
        query = source.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


class Projection:
    """The last state of each key from change envelopes (op, key, pos, fields)."""

    def __init__(self, spark: SparkSession, root: str, fields: list[str]):
        self.deltas, self.fields = Deltas(spark, root), fields

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.deltas.batch():
            return
        acts = batch.filter(E.action(F.col("op")) != "skip")
        # A deletion stays as the last entry of its key, so that an older delivery can't bring it back.
        last = acts.groupBy("key").agg(F.max_by(F.struct("op", *self.fields), "pos").alias("x"), F.max("pos").alias("pos")).select("key", "pos", "x.*")
        self.deltas.publish({"log": last.select("op", "key", "pos", *self.fields)}, number)

    def state(self) -> DataFrame | None:
        log = self.deltas.read("log")
        return None if log is None else E.final_state(log, "key", "pos", self.fields)

    def run(self, path: str, schema: StructType, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
        query = stream(self.deltas.spark, path, schema, max_files).writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def deduplicated(events: DataFrame, event: str, at: str, within: str) -> DataFrame:
    """A stream without repeats that come within a time of each other; the state is bounded by that time."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([event])


def minute_rollup(events: DataFrame, at: str, late: str) -> DataFrame:
    """(minute, key, cnt) of a stream, each minute once it is past `late`."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 minute").alias("w"), "key").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("minute"), "key", "cnt")


class OutboxRelay:
    """Publishes unpublished rows in order, then marks them; a repeat after a crash is a duplicate that the consumer drops."""

    def __init__(self, spark: SparkSession, outbox: DataFrame, root: str, topic: str):
        self.deltas, self.outbox, self.topic = Deltas(spark, root), outbox, topic
        self.hook: Callable[[str], None] = lambda point: None

    def relay(self, n: int) -> int:
        marked = self.deltas.read("published")
        due = self.outbox if marked is None else self.outbox.join(marked, "id", "left_anti")
        batch = due.orderBy("id").limit(n).persist()
        try:
            count = batch.count()
            if count:
                batch.select(F.to_json(F.struct("event_id", "account_id", "amount")).alias("value")).write.mode("append").text(self.topic)
                self.hook("published")
                self.deltas.publish({"published": batch.select("id")}, self.deltas.batch() + 1)
            return count
        finally:
            batch.unpersist()
