"""Clip events as streams: windowed counts, and runs of equal values in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A run ends where nothing follows for so long.
GAP_MS = 7 * 24 * 3600 * 1000


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Events and their total value per tumbling window; works on tables and streams alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    agg = rows.groupBy(F.window(time, every), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), by, "n", "total")


def _rows(events: DataFrame, key: str, time: str, order: str, value: str) -> DataFrame:
    return events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(order).cast("long").alias("ord"), F.col(value).cast("string").alias("value"))


def batch_runs(events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", value: str = "event_type", gap_ms: int = GAP_MS) -> DataFrame:
    """``key, value, first, last, n``: maximal runs of equal values of a key in order of time, none across a gap; times in ms."""
    o = Window.partitionBy("key").orderBy("time", "ord")
    rows = _rows(events, key, time, order, value).withColumn("at", F.unix_millis("time"))
    new = ~F.col("value").eqNullSafe(F.lag("value").over(o)) | (F.col("at") - F.lag("at").over(o) > gap_ms)
    rows = rows.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(o))
    return rows.groupBy("key", "run").agg(F.first("value").alias("value"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).drop("run").select(F.col("key").alias(key), F.col("value").alias(value), "first", "last", "n")


class RunCollapse(StatefulProcessor):
    """Rows wait, out of order, until the watermark has passed them; then they extend the key's open run or close it.

    A run is also closed once the watermark has passed its last row by the gap. Rows that
    come behind the watermark are late and left out. State of a key: rows not yet passed
    and one open run.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ord long, value string")
        self.open = handle.getValueState("open", "value string, first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [(r.at, r.ord, r.value) for r in rows if r.at > passed]
        if fresh:
            self.waiting.appendList(fresh)
            for at in {r[0] for r in fresh}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        run = self.open.get() if self.open.exists() else None
        closed = []
        for at, _, value in ready:
            if run is not None and run[0] == value and at - run[2] <= self.gap_ms:
                run = (value, run[1], at, run[3] + 1)
            else:
                if run is not None:
                    closed.append(run)
                run = (value, at, at, 1)
        if run is not None and run[2] + self.gap_ms < passed:
            closed.append(run)
            run = None
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if run is None:
            self.open.clear()
        else:
            self.open.update(run)
            self.handle.registerTimer(run[2] + self.gap_ms + 1)
        for value, first, last, n in closed:
            yield Row(key=key[0], value=value, first=first, last=last, n=n)

    def close(self) -> None:
        pass


def stream_runs(events: DataFrame, late: str = "2 hours", key: str = "user_id", time: str = "ts", order: str = "event_id", value: str = "event_type", gap_ms: int = GAP_MS) -> DataFrame:
    """``batch_runs`` of a stream, each run once it can't change any more; needs the RocksDB state store.

    The sink must take each batch once, as ``write_once`` does.
    """
    rows = _rows(events, key, time, order, value).withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    found = rows.groupBy("key").transformWithState(RunCollapse(gap_ms), "key long, value string, first long, last long, n long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.col("value").alias(value), "first", "last", "n")


def write_once(folder: str):
    """A ``foreachBatch`` writer: each batch has a folder of its own, which counts once its writer has marked it as whole.

    The marks are the ledger: a batch that comes again after a restart is left out if it
    is marked, and written anew, in place of what is there, if it is not.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
