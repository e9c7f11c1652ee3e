"""Exactly-once logs, documents as VARIANT, stateful runs, drift by window."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from conftest import values
from runledger.operators import drift, runs
from runledger.sources import texts
from runledger.streaming import logs


def test_a_batch_counts_once_whatever_fails(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(ValueError):
        texts.read_committed(spark, path)
    assert texts.append_once(spark.range(10), path, "one") and not texts.append_once(spark.range(10), path, "one")

    broken = spark.range(100, 200, 1, 4).withColumn("id", F.when(F.col("id") == 190, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):   # between tasks
        texts.append_once(broken, path, "two")
    assert texts.read_committed(spark, path).count() == 10
    spark.range(100, 150).write.mode("overwrite").parquet(f"{path}/batch=two")   # between the data and its mark
    assert texts.read_committed(spark, path).count() == 10
    assert texts.append_once(spark.range(100, 200), path, "two")
    assert values(texts.read_committed(spark, path), "id") == sorted([(i,) for i in [*range(10), *range(100, 200)]], key=repr)
    texts.compact(spark, path, "all")
    texts.compact(spark, path, "all")
    assert texts.committed(spark, path) == ["all"] and texts.read_committed(spark, path).count() == 110
    with pytest.raises(ValueError):
        texts.append_once(spark.range(1), path, "a/b")


def test_variant_documents_keep_everything(make):
    rows = [(1, '{"lr":0.5,"o":{"n":"x","s":[1,"a",null,{}]},"f":true,"e":[]}'), (2, "{bad"), (3, None), (4, "7"), (5, '{"z": "7", "big": 12345678901234}')]
    documents = texts.variant_documents(make(rows, "id int, content string"))
    assert values(documents.filter("error IS NOT NULL"), "id") == [(2,)]
    none = (None, None, None)
    assert values(texts.variant_fields(documents, ["id"])) == sorted([
        (4, "$", "number", None, 7.0, None), (1, "$.e", "array", *none), (1, "$.f", "boolean", None, None, True), (1, "$.lr", "number", None, 0.5, None),
        (1, "$.o.n", "string", "x", None, None), (1, "$.o.s[0]", "number", None, 1.0, None), (1, "$.o.s[1]", "string", "a", None, None),
        (1, "$.o.s[2]", "null", *none), (1, "$.o.s[3]", "object", *none), (5, "$.z", "string", "7", None, None), (5, "$.big", "number", None, 12345678901234.0, None)], key=repr)


RUN = "run_id string, seq bigint, event string, ts timestamp"


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


def test_run_states_with_deletions_over_restarts(spark, make, tmp_path):
    rows = [("a", 1, "start", at(0)), ("b", 2, "start", at(10)), ("a", 3, "success", at(60)), ("b", 4, "deleted", None), ("b", 5, "start", at(90)),
            ("c", 6, "failed", at(100)), ("d", 7, "start", at(110)), ("d", None, "deleted", None), ("d", 9, "success", at(130)), ("a", 10, "failed", at(140))]
    def append(part):
        for row in part:
            make([row], RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    def drain(files):
        stream = logs.read_log_stream(spark, str(tmp_path / "log"), RUN, files)
        return logs.run_to_table(logs.stream_run_states(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    append(rows[:6])
    drain(1)
    append(rows[6:])   # a second query goes on from the stored state
    got = logs.latest_states(drain(1))
    events = make([r for r in rows if r[2] != "deleted"], RUN)
    gone = make([("b", 4), ("d", 99)], "run_id string, seq bigint")
    columns = ["run_id", "status", "started_at", "ended_at", "duration_seconds", "updated_at"]
    assert values(got, *columns) == values(runs.run_state(events, gone), *columns)


def test_a_run_costs_two_calls_and_no_frame():
    """Runs come as plain rows, unordered; their state is read once and written once."""
    calls, stored = [], []
    state = SimpleNamespace(get=lambda: calls.append("get") or (stored[-1] if stored else None), update=lambda v: calls.append("update") or stored.append(v))
    states = logs.RunStates(None, None)
    states.init(SimpleNamespace(getValueState=lambda *_: state))
    row, big = Row("run_id", "seq", "event", "micros"), (1 << 53) + 1
    first, = states.handleInputRows(("a",), iter([row("a", 5, "success", 50), row("a", 4, "start", None), row("a", 3, "start", 30), row("a", 2, "deleted", None), row("a", 1, "start", 10)]), None)
    assert first.asDict() == {"run_id": "a", "status": "success", "started": 30, "ended": 50, "seq": 5, "deleted": False}
    second, = states.handleInputRows(("a",), iter([row("a", big + 1, "failed", 90), row("a", big, "deleted", None)]), None)
    assert second.asDict() == {"run_id": "a", "status": "failed", "started": None, "ended": 90, "seq": big + 1, "deleted": False}
    third, = states.handleInputRows(("a",), iter([row("a", None, "deleted", None)]), None)
    assert third.deleted and third.status is None and calls == ["get", "update"] * 3


def test_idle_runs_are_reported(spark, make, tmp_path):
    make([("a", 1, "start", at(0)), ("b", 2, "start", at(0)), ("b", 3, "success", at(1))], RUN).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = logs.read_log_stream(spark, str(tmp_path / "log"), RUN)
    seen = []
    query = (logs.stream_run_states(stream, idle="1 second", keep="1 day").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
             .foreachBatch(lambda batch, k: seen.extend((r["run_id"], r["status"]) for r in batch.collect())).trigger(processingTime="1 second").start())
    for _ in range(60):
        if ("a", "idle") in seen or query.exception():
            break
        query.awaitTermination(1)
    query.stop()
    assert ("a", "idle") in seen and ("b", "idle") not in seen and ("b", "success") in seen


@pytest.mark.parametrize("files", [1, 20])
def test_windowed_drift_does_not_depend_on_the_batches(spark, make, tmp_path, files):
    schema = "ts timestamp, value double, kind string, whole bigint"
    rows = [(at(60 * i), float((i * 37) % 50) + (30 if i > 120 else 0), "abc"[i % 3 if i < 100 else 0], i % 5) for i in range(240)] + [(at(300), None, None, None)]
    for k in range(20):
        make(sorted(rows, key=lambda r: r[0])[k * 12:k * 12 + 13 if k == 19 else k * 12 + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    reference = make([(float(i % 60), "abc"[i % 3], i % 5) for i in range(300)], "value double, kind string, whole bigint")
    stream = logs.read_log_stream(spark, str(tmp_path / "log"), schema, files)
    windows = logs.run_to_table(logs.stream_value_windows(stream, ["value", "kind", "whole"], "1 hour", "0 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    counted = drift.value_counts(reference, drift.plan_columns(reference.schema, reference.schema))
    found = {(r["start"], r["column"]): r for r in drift.window_drift(counted, windows, ["start"]).collect()}
    assert {k[0] for k in found} == {at(3600 * h) for h in range(3)}
    for hour in range(3):
        part = make([r for r in rows if at(3600 * hour) <= r[0] < at(3600 * hour + 3600)], schema)
        for want in drift.drift_report(reference, part).collect():
            got = found[at(3600 * hour), want["column"]]
            assert got["type"] == want["type"] and got["drift_detected"] == want["drift_detected"]
            assert got["ks_statistic"] == pytest.approx(want["ks_statistic"]) and got["frequency_distance"] == pytest.approx(want["frequency_distance"])
            assert got["p_value"] == pytest.approx(want["p_value"])
