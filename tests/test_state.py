"""Run tracking and the model registry against small hand-made logs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import cards, mining, registry, retention, runs
from runledger.sources import texts

EVENTS = "run_id string, seq bigint, event string, ts timestamp"


def at(second):
    from datetime import datetime, timedelta
    return datetime(2024, 1, 1) + timedelta(seconds=second)


@pytest.fixture
def logs(make):
    events = make([("a", 0, "start", at(0)), ("b", 1, "start", at(10)), ("a", 2, "success", at(5)), ("c", 3, "start", at(20)),
                   ("c", 4, "failed", at(19)), ("d", 5, "failed", at(50))], EVENTS)
    params = make([("a", 0, "lr", "0.001"), ("a", 1, "optimizer", "adam"), ("a", 2, "lr", "0.1"), ("b", 3, "DataSet", "x"), ("b", 4, "lr", "0.1")],
                  "run_id string, seq bigint, key string, value string")
    metrics = make([("a", 0, 9, at(1), "val_loss", 0.42), ("a", 1, 2, at(2), "val_loss", 0.30), ("a", 1, 2, at(2), "acc", 0.8),
                    ("b", 2, 1, at(11), "val_loss", 0.12), ("b", 3, 2, at(12), "acc", 0.95), ("c", 4, 1, at(21), "acc", float("nan")),
                    ("d", 5, 1, at(22), "acc", 0.95)],
                   "run_id string, seq bigint, step bigint, ts timestamp, key string, value double")
    return events, params, metrics


def test_run_state(logs):
    got = {r["run_id"]: (r["status"], r["duration_seconds"], r["updated_at"]) for r in runs.run_state(logs[0]).collect()}
    assert got == {"a": ("success", 5.0, at(5)), "b": ("running", None, at(10)), "c": ("failed", 0.0, at(19)), "d": ("failed", None, at(50))}
    assert [r["run_id"] for r in runs.latest_run_ids(logs[0]).collect()] == ["d", "c", "b", "a"]


def test_latest_entry_is_the_last_appended(logs):
    rows = {r["run_id"]: r["latest_metrics"] for r in runs.list_runs(logs[0], logs[2]).collect()}
    assert rows["a"] == {"val_loss": 0.30, "acc": 0.8} and rows["b"] == {"acc": 0.95}
    assert values(runs.current_params(logs[1])) == [("a", "lr", "0.1"), ("a", "optimizer", "adam"), ("b", "DataSet", "x"), ("b", "lr", "0.1")]


def test_best_run(logs):
    events, _, metrics = logs
    best = runs.best_run(events, metrics, "acc").first()
    assert (best["run_id"], best["value"]) == ("d", 0.95)          # a tie goes to the more recent run
    assert runs.best_run(events, metrics, "acc", "min").first()["run_id"] == "a"
    assert runs.best_run(events, metrics, "val_loss", "min").first()["run_id"] == "a"   # b's last entry has no val_loss
    assert runs.best_run(events, metrics, "none").isEmpty()
    with pytest.raises(ValueError):
        runs.best_run(events, metrics, "acc", "best")
    assert values(runs.best_runs(events, metrics), "metric", "run_id") == [("acc", "d"), ("val_loss", "a")]


def test_compare_export_and_state_rows(logs):
    rows = runs.run_snapshot_rows(*logs)
    diff = {(r["run_id"], r["key"]): (r["old"], r["new"]) for r in runs.compare_runs(rows, ["a", "b"]).collect()}
    assert diff[("b", "params.optimizer")] == ("adam", None) and diff[("b", "params.DataSet")] == (None, "x")
    assert diff[("b", "latest_metrics.acc")] == ("0.8", "0.95") and ("b", "params.lr") not in diff
    assert runs.compare_runs(rows, ["a", "a"]).isEmpty()
    with pytest.raises(ValueError):
        runs.compare_runs(rows, ["a"])
    wide = {r["run_id"]: r.asDict() for r in runs.export_runs(*logs).collect()}
    assert wide["a"]["param_lr"] == "0.1" and wide["a"]["metric_acc"] == 0.8 and wide["b"]["metric_val_loss"] is None
    assert set(wide) == {"a", "b", "c", "d"}
    chosen = runs.export_runs(*logs, param_keys=["lr"], metric_keys=[])
    assert chosen.columns == ["run_id", "status", "started_at", "duration_seconds", "param_lr"]
    gone = logs[0].sparkSession.createDataFrame([("a",)], "run_id string")
    assert {r["run_id"] for r in runs.export_runs(*logs, tombstones=gone).collect()} == {"b", "c", "d"}
    assert runs.run_snapshot_rows(*logs, gone).filter("run_id = 'a'").isEmpty() and runs.get_run(*logs, tombstones=gone).filter("run_id = 'a'").isEmpty()
    asked = logs[0].sparkSession.createDataFrame([("a",), ("b",), ("zz",)], "run_id string")
    assert values(runs.unknown_runs(logs[0], asked, gone)) == [("a", "run not found"), ("zz", "run not found")]
    state = runs.get_run(*logs, run_ids=["a"])
    assert values(state.filter("section = 'metrics'"), "seq", "key", "value") == [(0, "val_loss", "0.42"), (1, "acc", "0.8"), (1, "val_loss", "0.3")]


def test_appending_checks(make, logs):
    state = runs.run_state(logs[0])
    batch = runs.log_metrics(make([("a", "acc"), ("zz", "acc"), ("b", "step")], "run_id string, key string"), state)
    assert values(runs.rejected(batch), "run_id", "reason") == [("b", "reserved metric name"), ("zz", "run not found")]
    assert values(runs.accepted(batch)) == [("a", "acc")]
    ended = runs.finish_runs(make([("a", 9, "success", at(9)), ("b", 9, "done", at(9))], "run_id string, seq bigint, status string, ts timestamp"), state)
    assert values(runs.rejected(ended), "run_id") == [("b",)]
    files = make([("f.pt", 7, False), ("dir", 0, True)], "path string, size bigint, is_dir boolean")
    manifest = runs.log_artifacts(make([("a", 1, "f.pt", at(1)), ("a", 2, "dir", at(1))], "run_id string, seq bigint, source string, logged_at timestamp"), state, files)
    assert values(manifest, "source", "path", "size", "reason") == [
        ("dir", "artifacts/dir", None, "artifact file not found"), ("f.pt", "artifacts/f.pt", 7, None)]
    ids = make([("n1",), ("n2",)], "run_id string")
    assert values(runs.run_state(runs.create_runs(ids)), "run_id", "status") == [("n1", "running"), ("n2", "running")]


def test_delete_and_retention(make, logs):
    ids = make([("a",), ("zz",)], "run_id string")
    assert values(runs.delete_runs(logs[0], ids, dry_run=True)) == [("a", False)]
    assert "a" not in {r["run_id"] for r in runs.run_state(logs[0], runs.delete_runs(logs[0], ids)).collect()}
    state = make([("ok", "success"), ("bad", "failed"), ("live", "running"), ("odd", None), ("nolog", "success")], "run_id string, status string")
    got = {r["run_id"]: r["action"] for r in retention.retention_runs(state, make([("ok",), ("ok",), ("bad",), ("odd",)], "run_id string")).collect()}
    assert got == {"ok": "keep", "bad": "remove", "live": "remove", "odd": "remove", "nolog": "remove"}


def test_report_and_snapshot(make, logs):
    lines = [r["line"] for r in cards.experiment_report(*logs, "p").orderBy("section", "item").collect()]
    assert lines[3] == "- Run Count: 4" and lines[6] == "- d: status=failed, duration=None" and "    run2[c] --> compare" in lines
    alone = tuple(df.filter("run_id = 'a'") for df in logs)
    assert "No comparison available" in [r["line"] for r in cards.experiment_report(*alone, "p").collect()]
    rows, manifest = mining.run_snapshot(runs.run_snapshot_rows(*logs), make([("a",)], "run_id string"), "20240201")
    assert manifest.first()["row_count"] == rows.count() and rows.select("snapshot").distinct().count() == 1


def test_existing_documents_load(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    (run / "params.json").write_text(json.dumps({"lr": 0.1, "opt": "adam"}, indent=2))
    (run / "metrics.json").write_text(json.dumps([{"step": 1, "timestamp": "2024-01-01T00:00:00+00:00", "loss": 0.5}, {"step": 2, "loss": 0.25, "note": "x"}]))
    (run / "artifacts.json").write_text(json.dumps([{"source": "/s/a", "path": "artifacts/a", "size": 3, "logged_at": "2024-01-01T00:00:00+00:00"}]))
    (run / "status.json").write_text(json.dumps({"status": "success", "started_at": "2024-01-01T00:00:00+00:00", "ended_at": "2024-01-01T00:01:00+00:00"}))
    logs = texts.read_run_documents(spark, str(tmp_path))
    assert runs.run_state(logs["run_events"]).first()["duration_seconds"] == 60.0
    latest = {r["key"]: r["value"] for r in runs.latest_metrics(logs["metrics"]).collect()}
    assert latest == {"loss": 0.25, "note": None}
    assert values(runs.current_params(logs["params"]), "key", "value") == [("lr", "0.1"), ("opt", "adam")]
    assert logs["artifacts"].first()["size"] == 3
    (tmp_path / "lineage.json").write_text(json.dumps({"records": [{"output": "o", "inputs": ["i"], "run_id": "r1", "timestamp": "2024-01-01T00:00:00+00:00"}]}, indent=1))
    record = texts.read_lineage_document(spark, str(tmp_path / "lineage.json")).first()
    assert (record["seq"], record["output"], record["inputs"]) == (0, "o", ["i"])


def test_append_log(spark, make, tmp_path):
    path = str(tmp_path / "log")
    texts.append_log(make([("a", 1)], "run_id string, seq int"), path, "run_id")
    texts.append_log(make([("b", 2)], "run_id string, seq int"), path, "run_id")
    assert values(texts.read_log(spark, path), "run_id", "seq") == [("a", 1), ("b", 2)]


# --- registry

BATCH = "name string, seq bigint, path string, run_id string, version bigint, stage string, ts timestamp"


def register_by_hand(batch, existing, files):
    taken = {}
    for name, version in existing:
        taken.setdefault(name, set()).add(version)
    out = []
    for name, seq, path, _, version, _, _ in sorted(batch, key=lambda r: r[1]):
        held = taken.setdefault(name, set())
        if path not in files:
            out.append((name, version, seq, "model file not found"))
            continue
        number = version if version is not None else max(held, default=0) + 1
        refused = number in held
        held.add(number)
        out.append((name, number, seq, "version already exists" if refused else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [7, 1_000_000])
def test_registration_equals_one_by_one(make, seed):
    rng = random.Random(seed)
    batch = [("hot" if i % 3 == 0 else rng.choice("xyz"), i, rng.choice(["m.pt", "gone"]) if i % 5 == 0 else "m.pt", "r",
              rng.randint(1, 25) if rng.random() < 0.3 else None, "dev", at(i)) for i in range(90)]
    existing = [("hot", 1), ("hot", 5), ("x", 3)]
    got = registry.register_models(make(batch, BATCH), make(existing, "name string, version bigint"),
                                   make([("m.pt", 16, False), ("gone", 0, True)], "path string, size bigint, is_dir boolean"))
    assert values(got, "name", "version", "seq", "reason") == register_by_hand(batch, existing, {"m.pt"})
    first = got.filter("reason IS NULL").first()
    assert (first["framework"], first["size"]) == ("pytorch", 16)


def test_stages_tags_and_deletion(make):
    versions = make([("net", 1, "r1", "n1.pt", 10, "pytorch"), ("net", 2, "r2", "n2.pt", 20, "pytorch"), ("old", 1, None, "o.pkl", 5, "sklearn")],
                    "name string, version bigint, run_id string, path string, size bigint, framework string")
    stages = make([("net", 1, 0, "dev", at(0), None), ("net", 2, 1, "dev", at(1), None), ("old", 1, 2, "dev", at(2), None)],
                  "name string, version bigint, seq bigint, stage string, ts timestamp, reason string")
    moves = make([("net", 1, 5, "staging", at(5)), ("net", 1, 6, "prod", at(6)), ("nope", 1, 7, "prod", at(7))], "name string, version bigint, seq bigint, stage string, ts timestamp")
    moved = registry.promote_models(moves, stages, versions)
    assert values(moved, "name", "seq", "from_stage", "error") == [("net", 5, "dev", None), ("net", 6, "staging", None), ("nope", 7, None, "model/version not found")]
    dropped = registry.deprecate_models(make([("old", 1, 9, at(9), "stale")], "name string, version bigint, seq bigint, ts timestamp, reason string"), stages, versions)
    log = stages.unionByName(moved.filter("error IS NULL").select(stages.columns)).unionByName(dropped.select(stages.columns))
    assert values(registry.current_stage(log)) == [("net", 1, "prod", None), ("net", 2, "dev", None), ("old", 1, "deprecated", "stale")]
    assert values(registry.list_models(versions, log)) == [("net", 2, 2, "dev"), ("old", 1, 1, "deprecated")]
    gone = registry.delete_model_versions(versions, make([("net", 2), ("old", 1), ("old", 7)], "name string, version bigint"))
    assert values(gone) == [("net", 2, None), ("old", 1, None), ("old", 7, "model/version not found")]
    assert values(registry.list_models(versions, log, gone.filter("error IS NULL"))) == [("net", 1, 1, "prod")]
    tags = registry.current_tags(make([("net", 1, 0, "k", "a"), ("net", 1, 1, "k", "b"), ("net", 1, 2, "m", "c")], "name string, version bigint, seq bigint, key string, value string"))
    assert values(tags, "key", "value") == [("k", "b"), ("m", "c")]
    info = registry.model_versions_with_files(versions, make([("n1.pt", 11, False)], "path string, size bigint, is_dir boolean"), log)
    assert values(info, "name", "version", "size", "file_exists") == [("net", 1, 11, True), ("net", 2, 20, False), ("old", 1, 5, False)]
    latest = make([("r1", "acc", 0.5), ("r2", "acc", 0.75)], "run_id string, key string, value double")
    facts = registry.model_facts(info, tags, latest)
    compared = registry.compare_model_versions(facts, make([("net", 1, 2)], "name string, version_a bigint, version_b bigint"))
    assert values(compared, "field", "a", "b") == [("framework", "pytorch", "pytorch"), ("latest_run_metrics.acc", "0.5", "0.75"), ("size", "11", "20"),
                                                   ("stage", "prod", "dev"), ("tags.k", "b", None), ("tags.m", "c", None)]
    hints = registry.model_lineage(versions, make([("r1", "success")], "run_id string, status string"),
                                   make([("r1", "trainData", "x.csv"), ("r1", "lr", "1"), ("r2", "my_dataset", "y")], "run_id string, key string, value string"))
    assert values(hints, "name", "version", "run_status", "dataset_hint") == [
        ("net", 1, "success", "trainData=x.csv"), ("net", 2, None, "my_dataset=y"), ("old", 1, None, None)]
    card = [r["line"] for r in cards.model_card(info, tags, hints).filter("doc = 'net/1'").orderBy("section", "item").collect()]
    assert card == ["# MODEL_CARD", "", "- Name: net", "- Version: 1", "- Stage: prod", "- Framework: pytorch", "- Path: n1.pt", "- Run ID: r1", "",
                    "## Tags", "- k: b", "- m: c", "", "## Dataset Hints", "- trainData=x.csv"]


def test_existing_registry_loads(spark, tmp_path):
    stamp = "2024-01-01T00:00:00+00:00"
    entry = {"name": "net", "version": 1, "stage": "deprecated", "run_id": "r1", "path": "/m/net.pt", "size": 16, "framework": "pytorch",
             "registered_at": stamp, "tags": {"k": "v"}, "deprecation_reason": "old",
             "stage_history": [{"stage": "dev", "timestamp": stamp}, {"stage": "deprecated", "from": "dev", "timestamp": stamp}]}
    (tmp_path / "models.json").write_text(json.dumps({"models": {"net": [entry, {**entry, "version": 2, "tags": {}, "stage_history": entry["stage_history"][:1]}]}}, indent=2))
    logs = texts.read_registry_document(spark, str(tmp_path / "models.json"))
    assert values(registry.list_models(logs["model_versions"], logs["stage_events"])) == [("net", 2, 2, "dev")]
    assert values(registry.current_stage(logs["stage_events"])) == [("net", 1, "deprecated", "old"), ("net", 2, "dev", None)]
    assert values(registry.stage_history(logs["stage_events"]), "version", "stage", "from_stage") == [
        (1, "deprecated", "dev"), (1, "dev", None), (2, "dev", None)]
    assert values(registry.current_tags(logs["tag_log"])) == [("net", 1, "k", "v")]


def test_old_only_metrics_make_no_column_and_odd_events_no_status(make):
    events = make([("a", 0, "start", at(0)), ("a", 1, "paused", at(1))], "run_id string, seq bigint, event string, ts timestamp")
    params = make([("a", 0, "lr", "1")], "run_id string, seq bigint, key string, value string")
    metrics = make([("a", 0, 0, at(0), "old", 1.0), ("a", 1, 1, at(1), "new", 2.0)], "run_id string, seq bigint, step bigint, ts timestamp, key string, value double")
    wide = runs.export_runs(events, params, metrics)
    assert "metric_new" in wide.columns and "metric_old" not in wide.columns
    assert wide.first()["status"] == "running"


def test_a_version_number_can_be_used_again(make):
    log = make([("m", 2, 5), ("m", 2, 20), ("m", 3, 6)], "name string, version bigint, seq bigint")
    gone = registry.delete_model_versions(log, make([("m", 2), ("m", 3)], "name string, version bigint"), 10)
    assert values(registry.live(log, gone), "version", "seq") == [(2, 20)]
    stages = log.selectExpr("*", "concat('s', seq) AS stage", "CAST(NULL AS STRING) AS reason")
    assert values(registry.current_stage(stages, gone), "version", "stage") == [(2, "s20")]
    forever = gone.select("name", "version")
    assert registry.live(log, forever).isEmpty()
