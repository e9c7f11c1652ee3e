"""The log and drift operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.drift import VALUE_KEYS, drift_report, plan_columns, value_counts, value_entries
from ..session import cut_lineage


def read_log_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A growing parquet log as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; logs written without a zone are read as UTC of the session."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def stream_latest_metrics(entries: DataFrame) -> DataFrame:
    """The metrics of each run's last entry as the log grows, as the batch form gives them; run it in update mode.

    ``entries`` has one row per entry: (run_id, seq, step, ts, metrics MAP).  State is one entry per run, however many keys
    older entries had.
    """
    return entries.groupBy("run_id").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in ("step", "ts", "metrics")])


def latest_rows(changes: DataFrame) -> DataFrame:
    """(run_id, seq, step, ts, key, value) from the drained changes of :func:`stream_latest_metrics`."""
    last = changes.groupBy("run_id").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in ("step", "ts", "metrics")])
    return last.select("run_id", "seq", "step", "ts", F.explode("metrics").alias("key", "value"))


def stream_metric_windows(metrics: DataFrame, length: str = "1 day", slide: str | None = None,
                          late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Count, sum and extremes per key and window; rows later than the watermark are dropped."""
    frame = F.window(ts, length, slide) if slide else F.window(ts, length)
    return metrics.withWatermark(ts, late).groupBy(frame.alias("window"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "n", "total", "low", "high")


def stream_run_sessions(metrics: DataFrame, gap: str = "5 minutes", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Bursts of activity per run: a session ends after ``gap`` without a row."""
    return metrics.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), "run_id").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("session.start").alias("start"), F.col("session.end").alias("end"), "run_id", "n")


def stream_dedup(texts: DataFrame, late: str = "1 day", ts: str = "ts", content: str = "content") -> DataFrame:
    """First arrival of every content within the watermark."""
    return texts.withColumn("md5", F.md5(content)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["md5"])


def stream_drift(stream: DataFrame, reference: DataFrame, columns: list[str], out_path: str) -> DataStreamWriter:
    """Every micro-batch against a fixed reference; reports are appended with their batch number.

    The reference is counted once and stored; batches meet its counts, not its rows.
    """
    counted = cut_lineage(value_counts(reference, plan_columns(reference.schema, stream.schema, columns)))

    def report(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        (drift_report(reference, batch, columns, counted).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}"))
        batch.unpersist()

    return stream.writeStream.foreachBatch(report)


def stream_value_windows(stream: DataFrame, columns: list[str], length: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(start, end, column, whole, real, text, n): how often each value occurs in each window, once the watermark has passed it.

    State is a count per window and value, which merges whatever arrives together.  :func:`runledger.operators.drift.window_drift` judges
    the windows; its verdicts do not depend on how the files were batched.
    """
    plan = plan_columns(stream.schema, stream.schema, columns)
    framed = stream.withWatermark(ts, late).withColumn("_window", F.window(ts, length))
    counted = value_entries(framed, plan, VALUE_KEYS, ("_window",)).groupBy("_window", *VALUE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *VALUE_KEYS, "n")


RUN_STATE = "run_id {}, status string, started bigint, ended bigint, seq bigint, deleted boolean"
_NEVER = 1 << 62
_EVENTS = ("start", "success", "failed")


class RunStates(StatefulProcessor):
    """One small state per run: its last event, its start and end, and up to which place in the log it is deleted.

    Runs are many and their rows few, so it works on plain rows: a frame per run costs more than the run.
    """

    def __init__(self, idle_ms: int | None, keep_ms: int | None):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    _row = staticmethod(Row("run_id", "status", "started", "ended", "seq", "deleted"))

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "code int, seq bigint, started bigint, end_seq bigint, ended bigint, gone bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        code, seq, started, end_seq, ended, gone = self.state.get() or (-1, -1, None, -1, None, -1)
        log = sorted(((_NEVER if at is None else at, event, micros) for _, at, event, micros in rows), key=itemgetter(0))
        for place, event, micros in log:
            if event == "deleted":
                gone = max(gone, place)
                if seq <= gone:
                    code, seq, started, end_seq, ended = -1, -1, None, -1, None
            elif place > gone:
                if place >= seq:
                    code, seq = _EVENTS.index(event), place
                if event == "start":
                    started = micros if started is None else started if micros is None else min(started, micros)
                elif place >= end_seq:
                    end_seq, ended = place, micros
        self.state.update((code, seq, started, end_seq, ended, gone))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if code == 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key[0], ("running", "success", "failed")[code] if code >= 0 else None, started, ended, seq, code < 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, seq, started, _, ended, _ = self.state.get()
        yield self._row(key[0], "idle", started, ended, seq, False)

    def close(self) -> None:
        pass


def stream_run_states(events: DataFrame, idle: str | None = None, keep: str | None = None) -> DataFrame:
    """Each run's state after every batch that changes it, from (run_id, seq, event, ts) with events start, success, failed and deleted.

    The log must bring a run's rows in the order of ``seq``; a deletion covers what came up to its ``seq``, without one all there ever is.
    A started run without news for ``idle`` is reported once as idle; a state untouched for ``keep`` is dropped.  Update mode.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = events.schema["run_id"].dataType.simpleString()
    rows = events.select("run_id", "seq", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    span = lambda text: None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)
    timed = "None" if idle is None and keep is None else "ProcessingTime"
    states = rows.groupBy("run_id").transformWithState(
        statefulProcessor=RunStates(span(idle), span(keep)), outputStructType=RUN_STATE.format(kind), outputMode="Update", timeMode=timed)
    at = F.timestamp_micros
    return states.select("run_id", "status", at("started").alias("started_at"), at("ended").alias("ended_at"),
                         at(F.coalesce("ended", "started")).alias("updated_at"), "seq", "deleted")


def latest_states(changes: DataFrame) -> DataFrame:
    """(run_id, status, started_at, ended_at, duration_seconds, updated_at) of the runs that are left, from drained changes."""
    last = changes.groupBy("run_id").agg(F.max_by(F.struct("status", "started_at", "ended_at", "updated_at", "deleted"), "batch_id").alias("s"))
    lasted = F.when(F.col("s.started_at").isNotNull() & F.col("s.ended_at").isNotNull(), F.greatest(
        F.lit(0.0), (F.unix_micros("s.ended_at") - F.unix_micros("s.started_at")) / 1e6))
    return last.filter("NOT s.deleted").select("run_id", "s.status", "s.started_at", "s.ended_at", lasted.alias("duration_seconds"), "s.updated_at")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available now into a parquet table and read it back.

    Update mode appends changed rows under their batch number, so a re-run of a batch
    overwrites its own folder; readers take the newest batch per key.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    fields = list(stream.schema.fields)
    if mode != "append":
        fields.append(StructField("batch_id", LongType()))
    return spark.read.schema(StructType(fields)).parquet(path)
