"""State by key: timers that tell without a batch, time to live, backlogs over blocks."""

import time
from datetime import datetime, timedelta

from conftest import rows_of
from gaugeweave.catalog import MetricCatalog
from gaugeweave.operators.delta import delta
from gaugeweave.session import scratch_dir
from gaugeweave.streaming.keyed import keyed_deltas, keyed_state, silent_hosts
from gaugeweave.streaming.run import read_files

CAT = MetricCatalog()


def started(stream, spark, label, every="1 second"):
    path = scratch_dir(spark, label)
    query = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", scratch_dir(spark, "state")).trigger(processingTime=every).start()
    return query, path


def found(spark, path, schema, at_least, seconds=45):
    end = time.time() + seconds
    rows = spark.createDataFrame([], schema)
    while time.time() < end:
        try:
            rows = spark.read.schema(schema).parquet(path)
            if rows.count() >= at_least:
                break
        except Exception:  # noqa: BLE001 - nothing is written yet
            pass
        time.sleep(1)
    return rows


def test_silence_is_told_by_the_clock_alone(spark, make):
    source = scratch_dir(spark, "arrivals")
    rows = make([("a", 1, 0), ("a", 2, 60), ("b", 1, 30)]).select("host", "ts")
    rows.write.parquet(source)
    with keyed_state(spark):
        query, path = started(silent_hosts(read_files(spark, source, rows.schema), timedelta(seconds=2), "processing"), spark, "silent")
    try:
        told = found(spark, path, "host string, ts_last timestamp_ntz", 2)
        time.sleep(2)
        assert rows_of(told, "host", "ts_last") == [("a", datetime(2024, 1, 1, 0, 1)), ("b", datetime(2024, 1, 1, 0, 0, 30))]
        assert query.lastProgress["numInputRows"] == 0  # no batch has arrived since the first one
    finally:
        query.stop()


def test_state_goes_after_its_time_to_live(spark, make):
    source = scratch_dir(spark, "arrivals")
    first, second = make([("a", 1, 0, 5)], "m"), make([("a", 2, 60, 9)], "m")
    first.write.parquet(source)
    with keyed_state(spark):
        query, path = started(keyed_deltas(read_files(spark, source, first.schema), CAT, ["m"], ttl_ms=3000), spark, "changes")
    try:
        end = time.time() + 40
        while not any(p["numInputRows"] for p in query.recentProgress) and time.time() < end:
            time.sleep(0.5)
        time.sleep(4)
        second.write.mode("append").parquet(source)
        while sum(p["numInputRows"] for p in query.recentProgress) < 2 and time.time() < end:
            time.sleep(0.5)
        schema = "host string, id long"
        assert found(spark, path, schema, 1, 3).count() == 0  # the host counts as new
    finally:
        query.stop()


def test_a_backlog_over_many_blocks_in_one_batch(spark, make):
    source = scratch_dir(spark, "arrivals")
    rows = make([("a", i, i * 10, (i * i) % 50) for i in range(60) if i not in (17, 32)], "m")
    rows.repartition(3).write.parquet(source)
    path = scratch_dir(spark, "changes")
    with keyed_state(spark, idle_batches=False):
        keyed_deltas(read_files(spark, source, rows.schema), CAT, ["m"], block=8).writeStream.format("parquet").option(
            "path", path).option("checkpointLocation", scratch_dir(spark, "state")).trigger(availableNow=True).start().awaitTermination(60)
    columns = ("host", "id", "ts_diff_seconds", "m_diff")
    assert rows_of(spark.read.parquet(path), *columns) == rows_of(delta(rows, CAT, ["m"], []), *columns)
