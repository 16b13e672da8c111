import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.events import encode_events, generate_events
from tidemark.plans.stream import StreamConfig, run_stream
from tidemark.sources.streams import kafka_source, scan_stream, text_source
from tidemark.streaming.bronze import (
    StreamTimeout,
    bronze_events,
    drain,
    scan_events,
    scan_quarantine,
    stream_bronze,
    write_stream_append,
)


@pytest.fixture
def places(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder, str(tmp_path / "out"), str(tmp_path / "checkpoint")


def put(folder, name, *lines):
    (folder / name).write_text("".join(f"{line}\n" for line in lines))


def message(n, **more):
    return json.dumps({"customer_id": f"CUST-{n:05d}", "monthly_charges": 50.5, "tenure_months": 3} | more)


def test_second_run_adds_nothing_and_new_files_are_added(spark, places):
    folder, out, checkpoint = places
    put(folder, "a.json", *[message(i) for i in range(5)])
    for _ in range(2):
        stream_bronze(spark, text_source(str(folder)), out, checkpoint)
        assert scan_events(spark, out).count() == 5
    put(folder, "b.json", message(7), message(8))
    stream_bronze(spark, text_source(str(folder)), out, checkpoint)
    ids = sorted(r.customer_id for r in scan_events(spark, out).collect())
    assert ids == [f"CUST-{i:05d}" for i in (0, 1, 2, 3, 4, 7, 8)]
    # One stamp per run that found something.
    assert scan_events(spark, out).select("ingested_at").distinct().count() == 2


def test_bad_messages_are_set_aside_with_their_text(spark, places):
    folder, out, checkpoint = places
    put(folder, "a.json", message(1), "not json", "[]", message(2, monthly_charges="12.5"), message(3, other=1))
    stream_bronze(spark, text_source(str(folder)), out, checkpoint)
    good = scan_events(spark, out)
    assert sorted(r.customer_id for r in good.collect()) == ["CUST-00001", "CUST-00003"]
    assert good.columns[-1] == "ingested_at" and len(good.columns) == 10
    kept = {r["_corrupt_record"]: r for r in scan_quarantine(spark, out).collect()}
    assert set(kept) == {"not json", "[]", message(2, monthly_charges="12.5")}
    assert kept[message(2, monthly_charges="12.5")].customer_id == "CUST-00002"


def test_every_message_as_a_row(spark, places):
    folder, out, checkpoint = places
    put(folder, "a.json", message(1), "not json", "[]", message(2, monthly_charges="12.5"))
    stream_bronze(spark, text_source(str(folder)), out, checkpoint, separate_corrupt=False)
    table = spark.read.parquet(out)
    assert len(table.columns) == 10
    assert table.count() == 4
    assert table.where("customer_id IS NULL").count() == 2
    assert table.where("customer_id = 'CUST-00002'").first().monthly_charges is None


def test_backlog_in_several_batches(spark, places):
    folder, out, checkpoint = places
    for i in range(4):
        put(folder, f"{i}.json", message(i))
    source = text_source(str(folder), files_per_batch=1)
    assert run_stream(spark, StreamConfig(source, out, checkpoint)) == 4
    assert scan_events(spark, out).count() == 4
    assert run_stream(spark, StreamConfig(source, out, checkpoint)) == 0
    assert text_source("x", bytes_per_batch=10).options == {"maxBytesPerTrigger": "10"}
    assert text_source("x").options == {"maxFilesPerTrigger": "10000"}
    assert text_source("x", files_per_batch=None).options == {}
    assert kafka_source("h:1", "t", "login").options["maxOffsetsPerTrigger"] == "50000000"


def test_all_batches_are_counted(spark, places):
    folder, out, checkpoint = places
    for i in range(120):
        put(folder, f"{i}.json", message(i))
    config = StreamConfig(text_source(str(folder), files_per_batch=1), out, checkpoint)
    assert run_stream(spark, config) == 120
    assert run_stream(spark, config) == 0
    assert scan_events(spark, out).count() == 120


def test_stream_without_rows_and_table_without_quarantine(spark, places):
    folder, out, checkpoint = places
    put(folder, "empty.json")
    stream_bronze(spark, text_source(str(folder)), out, checkpoint)
    assert scan_events(spark, out).count() == scan_quarantine(spark, out).count() == 0
    assert len(scan_events(spark, out).columns) == 10
    put(folder, "a.json", message(1))
    stream_bronze(spark, text_source(str(folder)), f"{out}2", f"{checkpoint}2", separate_corrupt=False)
    with pytest.raises(ValueError, match="separate_corrupt"):
        scan_events(spark, f"{out}2")


def test_interrupted_run_is_continued_without_loss_or_repeats(spark, places):
    folder, out, checkpoint = places
    for i in range(8):
        put(folder, f"{i}.json", message(10 * i), message(10 * i + 1))
    source = text_source(str(folder), files_per_batch=1)
    events = bronze_events(scan_stream(spark, source))
    query = write_stream_append(events, out, checkpoint, partition_by="quarantined")
    deadline = time.time() + 60
    while not query.recentProgress and time.time() < deadline:
        time.sleep(0.05)
    query.stop()
    stream_bronze(spark, source, out, checkpoint)
    ids = sorted(r.customer_id for r in scan_events(spark, out).collect())
    assert ids == [f"CUST-{10 * i + k:05d}" for i in range(8) for k in range(2)]


def test_batch_and_stream_share_the_code(spark, places):
    folder, out, checkpoint = places
    made = generate_events(spark.range(50), "id", at=F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    encode_events(made).write.mode("append").text(str(folder))
    stream_bronze(spark, text_source(str(folder)), out, checkpoint)
    batch = bronze_events(spark.read.text(str(folder))).drop("quarantined", "_corrupt_record")
    assert sorted(map(tuple, scan_events(spark, out).drop("ingested_at").collect())) == sorted(
        map(tuple, batch.drop("ingested_at").collect())
    )


def test_quarantine_is_pruned(spark, places):
    folder, out, checkpoint = places
    put(folder, "a.json", message(1), "not json")
    stream_bronze(spark, text_source(str(folder)), out, checkpoint)
    plan = scan_events(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarantined" in plan


def test_stateless(spark, places):
    folder, _, _ = places
    plan = bronze_events(spark.read.text(str(folder)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_timeout_stops_the_query(spark):
    class Slow:
        stopped = False

        def awaitTermination(self, timeout):  # noqa: N802
            return False

        def stop(self):
            self.stopped = True

    query = Slow()
    with pytest.raises(StreamTimeout):
        drain(query, 0.1)
    assert query.stopped


def test_topic_options():
    source = kafka_source("host:9093", "events", "login", min_partitions=64, max_offsets_per_trigger=10)
    assert source.fmt == "kafka" and source.path is None
    assert "login" not in repr(source)
    assert source.options == {
        "kafka.bootstrap.servers": "host:9093",
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": "login",
        "subscribe": "events",
        "startingOffsets": "earliest",
        "kafka.request.timeout.ms": "60000",
        "kafka.session.timeout.ms": "30000",
        "minPartitions": "64",
        "maxOffsetsPerTrigger": "10",
    }


def test_stream_of_bodies(spark, places):
    folder, _, _ = places
    df = scan_stream(spark, text_source(str(folder)))
    assert df.isStreaming and df.columns == ["value"]
