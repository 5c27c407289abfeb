"""Sources and streams: torn journals, version flips, crashes between an effect and its commit."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tally.sources import journals
from tally.streaming import ledger

SCHEMA = StructType().add("id", "long").add("op", "string")


def test_journals(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journals.read_jsonl(spark, path, SCHEMA).collect() == []
    journals.append_jsonl(spark.createDataFrame([(1, "a")], SCHEMA), path)
    journals.append_jsonl(spark.createDataFrame([(2, "b")], SCHEMA), path)
    assert sorted(r.id for r in journals.read_jsonl(spark, path, SCHEMA).collect()) == [1, 2]
    torn = tmp_path / "torn.jsonl"
    torn.write_text('{"id":1,"op":"x"}\n\n{"id":2,"op":"y"}\n{"id":3,"o')
    whole, rest = journals.read_jsonl_torn(spark, str(torn), SCHEMA)
    assert sorted(map(tuple, whole.collect())) == [(1, "x"), (2, "y")] and [r.line for r in rest.collect()] == ['{"id":3,"o']
    assert journals.read_jsonl_torn(spark, str(tmp_path / "none"), SCHEMA)[0].count() == 0


def test_bulk_load_prunes_by_shard(spark, tmp_path):
    path = str(tmp_path / "t")
    journals.bulk_load(spark.range(100).withColumn("shard", F.col("id") % 4), path, 4, "shard")
    plan = spark.read.parquet(path).filter("shard = 2")
    assert plan.count() == 25 and "PartitionFilters: [isnotnull(shard" in plan._jdf.queryExecution().toString()


def test_versions(spark, tmp_path):
    v = journals.Versions(spark, str(tmp_path / "v"))
    assert v.state() is None and v.read("t") is None
    v.publish({"t": spark.range(1)}, batch=1)
    v.publish({"t": spark.range(2)}, batch=2)
    assert v.state()["batch"] == 2 and v.read("t").count() == 2 and v.read("other") is None


def test_deltas(spark, tmp_path):
    d = journals.Deltas(spark, str(tmp_path / "d"))
    assert d.batch() == -1 and d.read("t") is None
    d.publish({"t": spark.range(1)}, 0)
    spark.range(9).write.parquet(str(tmp_path / "d/t/batch=1"))  # written, but a crash came before it counted
    assert d.batch() == 0 and d.read("t").count() == 1 and d.read("other") is None
    d.publish({"t": spark.range(2)}, 1)
    assert d.read("t").count() == 3 and d.read("t").columns == ["id"]


def test_connector_options(spark):
    got = journals.jdbc_options("jdbc:x://h/db", "orders", "id", 1, 900, 6, user="u")
    assert got["partitionColumn"] == "id" and (got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("1", "900", "6") and got["user"] == "u"
    got = journals.topic_options("h:9092", "events", 100)
    assert got["startingOffsets"] == "earliest" and got["maxOffsetsPerTrigger"] == "100" and got["subscribe"] == "events"
    rows = journals.keyed_messages(spark.createDataFrame([(7, "e1"), (None, "e2")], "account_id long, event_id string"), "account_id").collect()
    assert [(r.key, json.loads(r.value)) for r in rows] == [("7", {"account_id": 7, "event_id": "e1"}), (None, {"event_id": "e2"})]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            journals.scratch(Cluster, "x")
    assert "tally-x-" in journals.scratch(spark, "x")


def messages(tmp_path, n=40):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(4):
        lines = [json.dumps({"event_id": f"e{i}", "account_id": i % 3, "amount": i}) for i in range(f * n // 4, (f + 1) * n // 4)]
        lines += [lines[0], "broken", json.dumps({"event_id": f"p{f}", "account_id": 1, "amount": "7"})]
        (folder / f"{f}.txt").write_text("\n".join(lines))
    (folder / "9.txt").write_text(json.dumps({"event_id": "e5", "account_id": 2, "amount": 5}))
    return str(folder)


def want(n=40):
    return sorted((a, sum(i for i in range(n) if i % 3 == a)) for a in range(3))


@pytest.mark.parametrize("point", ["before", "after"])
def test_a_crash_changes_nothing(spark, tmp_path, point):
    folder, dead = messages(tmp_path), str(tmp_path / "dead")
    crashed = []

    def hook(at, batch):
        if at == point and batch == 1 and not crashed:
            crashed.append(batch)
            raise RuntimeError("crash")

    one = ledger.IdempotentLedger(spark, str(tmp_path / "state"), dead)
    one.hook = hook
    with pytest.raises(Exception, match="crash"):
        one.run(folder, str(tmp_path / "checkpoint"), 1)
    assert crashed
    two = ledger.IdempotentLedger(spark, str(tmp_path / "state"), dead)
    two.run(folder, str(tmp_path / "checkpoint"), 1)
    two.run(folder, str(tmp_path / "checkpoint"), 1)
    assert sorted(map(tuple, two.balances().collect())) == want()
    quarantined = journals.read_jsonl(spark, dead, StructType().add("value", "string").add("batch", "long"))
    assert sorted(r.value for r in quarantined.collect())[:1] == ["broken"] and quarantined.count() == 8


def test_projection_and_redelivery(spark, tmp_path):
    folder = tmp_path / "cdc"
    folder.mkdir()
    schema = StructType().add("op", "string").add("key", "long").add("pos", "long").add("v", "string")
    batches = [[("c", 1, 1, "a"), ("c", 2, 2, "b"), ("c", 3, 3, "c")], [("u", 1, 4, "d"), ("d", 2, 5, None), (None, 3, 6, None)], [("c", 2, 2, "b"), ("u", 1, 4, "d"), ("c", 1, 1, "a")]]
    for i, b in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("op", "key", "pos", "v"), x))) for x in b))
    p = ledger.Projection(spark, str(tmp_path / "p"), ["v"])
    assert p.state() is None
    p.run(str(folder), schema, str(tmp_path / "c"), 1)
    assert sorted(map(tuple, p.state().collect())) == [(1, "d"), (3, "c")]


def test_outbox_relay(spark, tmp_path):
    outbox = spark.createDataFrame([(i, f"e{i}", i % 2, 10) for i in range(10)], "id long, event_id string, account_id long, amount long")
    topic = str(tmp_path / "topic")
    relay = ledger.OutboxRelay(spark, outbox, str(tmp_path / "o"), topic)
    assert relay.relay(4) == 4

    def crash(point):
        raise RuntimeError(point)

    relay.hook = crash
    with pytest.raises(RuntimeError):
        relay.relay(4)
    relay.hook = lambda point: None
    assert [relay.relay(4), relay.relay(4), relay.relay(4)] == [4, 2, 0]
    assert spark.read.text(topic).count() == 14  # the crash published four twice
    led = ledger.IdempotentLedger(spark, str(tmp_path / "l"))
    led.run(topic, str(tmp_path / "c"))
    assert sorted(map(tuple, led.balances().collect())) == [(0, 50), (1, 50)]


def test_streaming_dedupe_and_rollup(spark, tmp_path):
    src = str(tmp_path / "s")
    rows = [(i % 6, i % 2, f"2024-01-01 00:0{i // 6}:00") for i in range(18)]
    spark.createDataFrame(rows, "event int, key int, ts string").select("event", "key", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("event int, key int, ts timestamp").parquet(src)

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    assert drained(ledger.deduplicated(stream(), "event", "ts", "10 minutes"), "once", "append").count() == 6
    got = drained(ledger.minute_rollup(stream(), "ts", "0 seconds"), "minutes", "complete")
    assert got.count() == 6 and got.agg(F.sum("cnt")).first()[0] == 18
