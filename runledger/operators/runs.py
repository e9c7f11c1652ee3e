"""Run tracking: append-only logs folded to current state.

Logs (all append-only):
  run_events (run_id, seq, event, ts)              event: start, success or failed
  params     (run_id, seq, key, value)             value as text
  metrics    (run_id, seq, step, ts, key, value)   one row per metric of an entry; seq numbers entries
  artifacts  (run_id, seq, source, path, size, logged_at)
  tombstones (run_id[, seq])                       with seq, only what was logged up to it is gone

Operators that append take a batch and return it with a column ``reason``: NULL for rows
to append, otherwise why the row is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import seconds_between
from .ranks import latest_by, newest

STATUSES = ["running", "success", "failed"]
RESERVED = ["step", "timestamp"]


def accepted(batch: DataFrame) -> DataFrame:
    return batch.filter("reason IS NULL").drop("reason")


def rejected(batch: DataFrame) -> DataFrame:
    return batch.filter("reason IS NOT NULL")


def _check_runs(batch: DataFrame, runs: DataFrame, *extra: tuple[Column, str]) -> DataFrame:
    known = runs.select("run_id").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "run not found")
    for test, text in extra:
        reason = reason.when(test, text)
    return batch.join(known, "run_id", "left").withColumn("reason", reason).drop("_known")


def without_deleted(log: DataFrame, tombstones: DataFrame | None, ids: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    """The one reader of deletes: a log without what its tombstones cover."""
    if tombstones is None:
        return log
    if "seq" not in tombstones.columns or "seq" not in log.columns:
        return log.join(tombstones.select(*ids).distinct(), ids, "left_anti")
    dead = tombstones.groupBy(*ids).agg(F.max("seq").alias("_dead"))
    return log.join(dead, ids, "left").filter(F.col("_dead").isNull() | (F.col("seq") > F.col("_dead"))).drop("_dead").select(*log.columns)


def unknown_runs(run_events: DataFrame, ids: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(run_id, reason) of the wanted runs that do not exist or were deleted."""
    known = without_deleted(run_events, tombstones).select("run_id").distinct()
    return ids.select("run_id").distinct().join(known, "run_id", "left_anti").withColumn("reason", F.lit("run not found"))


def create_runs(ids: DataFrame, seq: Column | int = 0, ts: Column | None = None) -> DataFrame:
    """Start events for new runs; ``ids`` must already hold fixed run_ids."""
    seq = F.lit(seq).cast("bigint") if isinstance(seq, int) else seq
    return ids.select("run_id", seq.alias("seq"), F.lit("start").alias("event"),
                      (F.current_timestamp() if ts is None else ts).alias("ts"))


def log_params(batch: DataFrame, runs: DataFrame) -> DataFrame:
    return _check_runs(batch, runs)


def log_metrics(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows to append; ``step`` and ``timestamp`` are no metric names."""
    return _check_runs(batch, runs, (F.col("key").isin(RESERVED), "reserved metric name"))


def log_artifacts(batch: DataFrame, runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest rows (run_id, seq, source, path, size, logged_at, reason); the size comes from the catalog."""
    files = catalog.filter(~F.col("is_dir")).select(F.col("path").alias("source"), "size")
    sized = batch.join(files, "source", "left")
    checked = _check_runs(sized, runs, (F.col("size").isNull(), "artifact file not found"))
    name = F.concat(F.lit("artifacts/"), F.substring_index("source", "/", -1))
    return checked.select("run_id", "seq", "source", name.alias("path"), "size", "logged_at", "reason")


def finish_runs(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """End events from (run_id, seq, status, ts)."""
    checked = _check_runs(batch, runs, (~F.col("status").isin("success", "failed"),
                                        "status must be one of: success, failed"))
    return checked.select("run_id", "seq", F.col("status").alias("event"), "ts", "reason")


def run_state(run_events: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(run_id, status, started_at, ended_at, duration_seconds, updated_at), one row per run.

    Statuses are folded as small numbers: with only fixed-width buffers the aggregation
    hashes and combines on the map side, however long one run's log is.  Events of other names say nothing about a run.
    """
    code = F.when(F.col("event") == "start", 0).when(F.col("event") == "success", 1).when(F.col("event") == "failed", 2)
    ended = F.col("event") != "start"
    known = run_events.filter(F.col("event").isin("start", "success", "failed"))
    folded = without_deleted(known, tombstones).groupBy("run_id").agg(
        F.max_by(code, "seq").alias("_code"),
        F.min(F.when(~ended, F.col("ts"))).alias("started_at"),
        F.max_by(F.when(ended, F.col("ts")), F.when(ended, F.col("seq"))).alias("ended_at"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("_code") + 1)
    return folded.select(
        "run_id", status.alias("status"), "started_at", "ended_at",
        F.when(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull(), F.greatest(
            F.lit(0.0), seconds_between(F.col("started_at"), F.col("ended_at")))).alias("duration_seconds"),
        F.coalesce("ended_at", "started_at").alias("updated_at"))


def current_params(params: DataFrame) -> DataFrame:
    """(run_id, key, value): last value per key."""
    return latest_by(params, ["run_id", "key"], "seq", ["value"]).select("run_id", "key", "value")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """(run_id, seq, step, ts, key, value): the rows of each run's last appended entry.

    First the last row per (run, key), combined on the map side; the last entry of a run
    is then those with the run's highest seq.  The log itself is shuffled only in that
    reduced form and never joined back.
    """
    per_key = latest_by(metrics, ["run_id", "key"], "seq", ["step", "ts", "value"])
    top = F.max("seq").over(Window.partitionBy("run_id"))
    return (per_key.withColumn("_top", top).filter("seq = _top")
            .select("run_id", "seq", "step", "ts", "key", "value"))


def list_runs(run_events: DataFrame, metrics: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Runs with state and latest metrics map, most recently updated first."""
    latest = latest_metrics(without_deleted(metrics, tombstones)).groupBy("run_id").agg(
        F.max("step").alias("step"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("latest_metrics"))
    return (run_state(run_events, tombstones).join(latest, "run_id", "left")
            .orderBy(F.desc_nulls_last("updated_at"), "run_id"))


def latest_run_ids(run_events: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    return (run_state(run_events, tombstones).select("run_id", "updated_at")
            .orderBy(F.desc_nulls_last("updated_at"), "run_id"))


def _ranked_runs(run_events, metrics, direction, tombstones):
    if direction not in ("max", "min"):
        raise ValueError("direction must be one of: max, min")
    usable = latest_metrics(without_deleted(metrics, tombstones)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    order = [F.desc("value") if direction == "max" else F.asc("value"), F.desc_nulls_last("updated_at"), F.asc("run_id")]
    candidates = usable.join(run_state(run_events, tombstones), "run_id").select(
        F.col("key").alias("metric"), "run_id", "value", "status", "updated_at")
    return candidates, order


def best_run(run_events: DataFrame, metrics: DataFrame, metric: str, direction: str = "max",
             tombstones: DataFrame | None = None) -> DataFrame:
    """The best run by its latest entry's value of one metric; no row when no run has it."""
    candidates, order = _ranked_runs(run_events, metrics, direction, tombstones)
    return candidates.filter(F.col("metric") == metric).orderBy(*order).limit(1)


def best_runs(run_events: DataFrame, metrics: DataFrame, direction: str = "max", top: int = 1,
              tombstones: DataFrame | None = None) -> DataFrame:
    """The ``top`` best runs of every metric."""
    candidates, order = _ranked_runs(run_events, metrics, direction, tombstones)
    return newest(candidates, ["metric"], order, top)


def run_snapshot_rows(run_events: DataFrame, params: DataFrame, metrics: DataFrame,
                      tombstones: DataFrame | None = None) -> DataFrame:
    """Flattened state (run_id, key, value) with dotted keys: params., latest_metrics., status. One scan per log."""
    run_events, params, metrics = (without_deleted(log, tombstones) for log in (run_events, params, metrics))

    def dotted(prefix, key):
        return F.concat(F.lit(prefix + "."), key).alias("key")

    # The step is the entry's, so the row with the entry's smallest key carries it.
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("key")) == 1
    values = latest_metrics(metrics).withColumn("_first", first).select("run_id", F.inline(F.filter(F.array(
        F.struct(dotted("latest_metrics", F.col("key")), F.col("value").cast("string").alias("value")),
        F.when(F.col("_first"), F.struct(F.lit("latest_metrics.step").alias("key"), F.col("step").cast("string").alias("value")))),
        lambda x: x.isNotNull())))
    state = run_state(run_events).select("run_id", F.inline(F.array(*[
        F.struct(F.lit(f"status.{c}").alias("key"), F.col(c).cast("string").alias("value"))
        for c in ("status", "started_at", "ended_at", "duration_seconds")])))
    chosen = current_params(params).select("run_id", dotted("params", F.col("key")), "value")
    return chosen.unionAll(values).unionAll(state).filter("value IS NOT NULL")


def compare_runs(snapshots: DataFrame, run_ids: list) -> DataFrame:
    """(run_id, key, old, new): where each run differs from the first one.

    Base rows are repeated for every other run and met with its own in one aggregation;
    the log tables are filtered to the named runs first.
    """
    if len(run_ids) < 2:
        raise ValueError("run_ids must contain at least two runs")
    base, others = run_ids[0], run_ids[1:]
    kind = snapshots.schema["run_id"].dataType
    wanted = snapshots.filter(F.col("run_id").isin(run_ids))
    old = wanted.filter(F.col("run_id") == base).select(
        F.explode(F.array(*[F.lit(r).cast(kind) for r in others])).alias("run_id"), "key",
        F.col("value").alias("old"), F.lit(None).cast("string").alias("new"))
    new = wanted.filter(F.col("run_id").isin(others)).select(
        "run_id", "key", F.lit(None).cast("string").alias("old"), F.col("value").alias("new"))
    return (old.unionByName(new).groupBy("run_id", "key").agg(F.max("old").alias("old"), F.max("new").alias("new"))
            .filter(~F.col("old").eqNullSafe(F.col("new"))))


def get_run(run_events: DataFrame, params: DataFrame, metrics: DataFrame, artifacts: DataFrame | None = None,
            run_ids: list | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """Full state as rows (run_id, section, seq, key, value); a long history stays many rows."""
    run_events, params, metrics = (without_deleted(log, tombstones) for log in (run_events, params, metrics))
    artifacts = None if artifacts is None else without_deleted(artifacts, tombstones)

    def part(df: DataFrame, section: str, seq, key, value) -> DataFrame:
        df = df if run_ids is None else df.filter(F.col("run_id").isin(run_ids))
        return df.select("run_id", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"),
                         key.alias("key"), value.cast("string").alias("value"))

    state = run_state(run_events)
    none = F.lit(None)
    rows = part(current_params(params), "params", none, F.col("key"), F.col("value"))
    rows = rows.unionAll(part(metrics, "metrics", F.col("seq"), F.col("key"), F.col("value")))
    facts = state.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
        for c in ("status", "started_at", "ended_at", "duration_seconds")]))).filter("value IS NOT NULL")
    rows = rows.unionAll(part(facts, "status", none, F.col("key"), F.col("value")))
    if artifacts is not None:
        rows = rows.unionAll(part(artifacts, "artifacts", F.col("seq"), F.col("path"), F.col("size")))
    return rows


def delete_runs(run_events: DataFrame, ids: DataFrame, dry_run: bool = False) -> DataFrame:
    """Tombstones to append (run_id, deleted): only for runs that exist; ``dry_run`` marks them False."""
    known = run_state(run_events).select("run_id")
    return known.join(ids.select("run_id").distinct(), "run_id", "left_semi").withColumn("deleted", F.lit(not dry_run))


def export_runs(run_events: DataFrame, params: DataFrame, metrics: DataFrame, tombstones: DataFrame | None = None,
                param_keys: list[str] | None = None, metric_keys: list[str] | None = None) -> DataFrame:
    """Wide table: one row per run, one column per parameter and per latest metric.

    Keys that are not given are looked up among the current parameters and latest metrics: one name per column, so the list
    is as long as the table is wide.  :func:`run_snapshot_rows` is the long form.
    """
    run_events, params, metrics = (without_deleted(log, tombstones) for log in (run_events, params, metrics))
    wide = run_state(run_events).select("run_id", "status", "started_at", "duration_seconds")
    for prefix, source, names in (("param_", current_params(params), param_keys), ("metric_", latest_metrics(metrics), metric_keys)):
        if names is None:
            names = [r["key"] for r in source.select("key").distinct().orderBy("key").collect()]
        if names:
            table = source.groupBy("run_id").pivot("key", names).agg(F.first("value"))
            wide = wide.join(table.select("run_id", *[F.col(f"`{n}`").alias(prefix + n) for n in names]), "run_id", "left")
    return wide
