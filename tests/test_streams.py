"""Event-time runs, late rows, restarts, and observed progress."""

import random

import pytest
from pyspark.sql import functions as F

from clipgrain.streaming import progress as P
from clipgrain.streaming.clips import batch_runs, stream_runs, window_counts, write_once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"


def put(spark, folder, rows, k):
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "event_type")
    df.coalesce(1).write.parquet(f"{folder}/part={k}")


def drain(spark, folder, state, sink):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    query = stream_runs(rows, late="1 hour", gap_ms=2 * HOUR * 1000).writeStream.foreachBatch(write_once(sink)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_runs_with_late_rows_and_a_restart(rocks, tmp_path):
    spark, r = rocks, random.Random(2)
    rows = [(u, 1_700_000_000 + i * 300 + u, 1000 * u + i, r.choice("aab")) for u in (1, 2, 3) for i in range(0, 120)]
    rows = [x for x in rows if not 40 <= (x[1] - 1_700_000_000) // 300 < 80 or x[0] != 2]  # a gap
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for p in parts:
        r.shuffle(p)
    late = [(1, 1_700_000_000 + 30, 5, "late")]  # hours behind by the time it comes
    flush = [(9, 1_700_000_000 + 10**6, 9, "z")]
    folder, state, sink = (str(tmp_path / x) for x in ("in", "state", "sink"))
    for k, p in enumerate(parts[:3]):
        put(spark, folder, p, k)
    drain(spark, folder, state, sink)
    held = spark.read.parquet(sink).count()
    for k, p in enumerate([*parts[3:], late, flush, [(9, 1_700_000_000 + 2 * 10**6, 10, "y")]], 10):
        put(spark, folder, p, k)
    drain(spark, folder, state, sink)
    got = sorted(tuple(x) for x in spark.read.parquet(sink).where("user_id < 9").drop("batch").collect())
    table = spark.createDataFrame(rows, "user_id long, s long, event_id long, event_type string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "event_type")
    want = sorted(tuple(x) for x in batch_runs(table, gap_ms=2 * HOUR * 1000).collect())
    assert got == want and 0 < held < len(want)


def test_a_batch_is_written_once(spark, tmp_path):
    write, sink = write_once(str(tmp_path / "sink")), str(tmp_path / "sink")
    write(spark.range(3), 0)
    write(spark.range(100, 105), 0)  # the same batch once more
    write(spark.range(3, 5), 1)
    assert sorted(x["id"] for x in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4]
    import os

    os.remove(f"{sink}/batch=1/_SUCCESS")  # as if the writer had died
    write(spark.range(3, 5), 1)
    assert sorted(x["id"] for x in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4]


def test_window_counts_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = window_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r[0], r[1]): r[2] for r in window_counts(events).collect()}
    assert {(r[0], r[1]): r[2] for r in spark.table("windows").collect()} == batch
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_progress_costs_no_job(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df, seen = P.observed(events, F.col("event_type") == "error")
    spark.sparkContext.setJobGroup("watched", "watched")
    df.write.parquet(str(tmp_path / "out"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched"))
    got = seen.get
    assert (got["done"], got["failed"]) == (events.count(), events.where("event_type = 'error'").count())
    spark.sparkContext.setJobGroup("plain", "plain")
    events.write.parquet(str(tmp_path / "plain"))
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert P.progress(50, 3, 100, 10.0) == P.Progress(50, 3, 5.0, 10.0) and P.progress(0, 0, 9, 0.0).text(9) == "[0/9] ok=0 fail=0  rate=0.00/s  eta=0s"


def test_progress_of_a_stream(spark, tmp_path):
    import time

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    listener = P.ProgressListener(events.count())
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        df = stream.observe("progress", F.count(F.lit(1)).alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))
        df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.done == listener.total:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.done == listener.total and listener.batches == 3 and listener.failed == events.where("event_type = 'error'").count() and listener.progress.eta_s == 0
