"""Streams fed file by file give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import drift, runs
from runledger.streaming import logs

SCHEMA = "run_id string, seq bigint, step bigint, ts timestamp, key string, value double"


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


@pytest.fixture
def log(make, tmp_path):
    """Four appended files; the last holds a row far behind the watermark."""
    rows = [("r1" if i % 3 else "hot", i, i, at(i), "acc" if i % 2 else "loss", float(i % 7)) for i in range(60)]
    parts = [rows[:20], rows[20:40], rows[40:], [("late", 60, 60, at(-500), "acc", 1.0)]]
    for part in parts:
        make(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log"), make(rows + parts[3], SCHEMA)


def stream(spark, path):
    return logs.read_log_stream(spark, path, SCHEMA, max_files=1)


def test_latest_metrics(spark, log, tmp_path):
    path, batch = log
    entries = stream(spark, path).select("run_id", "seq", "step", "ts", F.create_map("key", "value").alias("metrics"))
    out = logs.run_to_table(logs.stream_latest_metrics(entries), str(tmp_path / "o"), str(tmp_path / "c"), "update")
    columns = ["run_id", "seq", "step", "ts", "key", "value"]
    assert values(logs.latest_rows(out), *columns) == values(runs.latest_metrics(batch), *columns)
    assert values(runs.latest_metrics(batch), "run_id", "seq") == [("hot", 57), ("late", 60), ("r1", 59)]


def test_windows_drop_late_rows(spark, log, tmp_path):
    path, batch = log
    out = logs.run_to_table(logs.stream_metric_windows(stream(spark, path), "10 minutes", late="5 minutes"), str(tmp_path / "o"), str(tmp_path / "c"))
    want = (batch.filter("run_id <> 'late'").groupBy(F.window("ts", "10 minutes").alias("w"), "key")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).filter(F.col("w.end") <= F.lit(at(54)))
            .select(F.col("w.start").alias("start"), "key", "n", "total"))
    assert values(out, "start", "key", "n", "total") == values(want)
    assert out.filter(F.col("start") < F.lit(at(0))).isEmpty()


def test_sliding_windows(spark, log, tmp_path):
    out = logs.run_to_table(logs.stream_metric_windows(stream(spark, log[0]), "10 minutes", "5 minutes", "5 minutes"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.select("start").distinct().count() > 8


def test_sessions(spark, make, tmp_path):
    rows = [("a", i, i, at(m), "k", 1.0) for i, m in enumerate([0, 1, 2, 30, 31, 500])]
    make(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    out = logs.run_to_table(logs.stream_run_sessions(stream(spark, str(tmp_path / "log"))), str(tmp_path / "o"), str(tmp_path / "c"))
    assert values(out, "start", "end", "n") == [(at(0), at(7), 3), (at(30), at(36), 2)]


def test_dedup_across_batches(spark, make, tmp_path):
    for part in ([(at(0), "x"), (at(1), "y")], [(at(2), "x"), (at(3), "z")]):
        make(part, "ts timestamp, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    texts = logs.read_log_stream(spark, str(tmp_path / "log"), "ts timestamp, content string", 1)
    out = logs.run_to_table(logs.stream_dedup(texts), str(tmp_path / "o"), str(tmp_path / "c"))
    assert values(out, "content") == [("x",), ("y",), ("z",)]


def test_drift_per_batch(spark, make, tmp_path):
    reference = make([(float(i), "a") for i in range(50)], "v double, s string")
    parts = [[(float(i), "a") for i in range(50)], [(float(i + 100), "b") for i in range(50)]]
    for part in parts:
        make(part, "v double, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = logs.read_log_stream(spark, str(tmp_path / "log"), "v double, s string", 1)
    writer = logs.stream_drift(source, reference, ["v", "s"], str(tmp_path / "o"))
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    for i, part in enumerate(parts):
        want = drift.drift_report(reference, make(part, "v double, s string"))
        assert values(got.filter(F.col("batch_id") == i), *want.columns) == values(want)
    assert values(got.filter("drift_detected"), "batch_id", "column") == [(1, "s"), (1, "v")]
