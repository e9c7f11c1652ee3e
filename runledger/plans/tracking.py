"""Queries: run tracking and the model registry."""

from pyspark.sql import functions as F

from ..operators import cards, mining, registry, retention, runs
from ..session import scratch_path
from ..sources import texts
from . import bindings as b
from .bindings import sql, table
from .registry import query


def _flat_map(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


# --- runs

@query(sql(["vstate"], "SELECT * FROM vstate"))
def run_state(spark, d):
    return runs.run_state(b.run_events(spark, d))


@query(sql(["vstate", "vlatest"], """SELECT s.*, l.step, l.latest_metrics FROM vstate s
LEFT JOIN (SELECT run_id, max(step) AS step, string_agg(key || '=' || value, ',' ORDER BY key) AS latest_metrics FROM vlatest GROUP BY run_id) l ON l.run_id = s.run_id"""))
def list_runs(spark, d):
    return runs.list_runs(b.run_events(spark, d), b.metrics(spark, d)).withColumn("latest_metrics", _flat_map("latest_metrics"))


@query(sql(["vstate"], "SELECT run_id, updated_at FROM vstate"))
def latest_run_ids(spark, d):
    return runs.latest_run_ids(b.run_events(spark, d))


@query(sql(["vlatest"], "SELECT run_id, seq, step, ts, key, value FROM vlatest"))
def latest_metrics(spark, d):
    return runs.latest_metrics(b.metrics(spark, d))


_BEST = """SELECT l.key AS metric, l.run_id, l.value, s.status, s.updated_at FROM vlatest l JOIN vstate s ON s.run_id = l.run_id
WHERE l.key = '{metric}' ORDER BY l.value {order}, s.updated_at DESC NULLS LAST, l.run_id LIMIT 1"""


@query(sql(["vstate", "vlatest"], _BEST.format(metric="click", order="DESC")))
def best_run(spark, d):
    return runs.best_run(b.run_events(spark, d), b.metrics(spark, d), "click")


@query(sql(["vstate", "vlatest"], _BEST.format(metric="view", order="ASC")))
def best_run_min(spark, d):
    return runs.best_run(b.run_events(spark, d), b.metrics(spark, d), "view", "min")


@query(sql(["vstate", "vlatest"], """SELECT metric, run_id, value, status, updated_at FROM (
  SELECT l.key AS metric, l.run_id, l.value, s.status, s.updated_at,
         row_number() OVER (PARTITION BY l.key ORDER BY l.value DESC, s.updated_at DESC NULLS LAST, l.run_id) AS r
  FROM vlatest l JOIN vstate s ON s.run_id = l.run_id) WHERE r <= 3"""))
def best_runs(spark, d):
    return runs.best_runs(b.run_events(spark, d), b.metrics(spark, d), top=3)


_STAMP = "rtrim(rtrim(strftime({}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
_SNAPSHOT = """snap AS (
  SELECT run_id, 'params.' || key AS key, value FROM vcurrent_params
  UNION ALL SELECT run_id, 'latest_metrics.' || key, CAST(value AS VARCHAR) FROM vlatest
  UNION ALL SELECT DISTINCT run_id, 'latest_metrics.step', CAST(step AS VARCHAR) FROM vlatest
  UNION ALL SELECT run_id, 'status.status', status FROM vstate
  UNION ALL SELECT run_id, 'status.started_at', rtrim(rtrim(strftime(started_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') FROM vstate WHERE started_at IS NOT NULL
  UNION ALL SELECT run_id, 'status.ended_at', rtrim(rtrim(strftime(ended_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') FROM vstate WHERE ended_at IS NOT NULL
  UNION ALL SELECT run_id, 'status.duration_seconds', CAST(duration_seconds AS VARCHAR) FROM vstate WHERE duration_seconds IS NOT NULL)"""


@query(sql(["vstate", "vlatest", "vcurrent_params"], f", {_SNAPSHOT} SELECT * FROM snap"))
def run_snapshot_rows(spark, d):
    return runs.run_snapshot_rows(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d))


@query(sql(["vstate", "vlatest", "vcurrent_params"], f""", {_SNAPSHOT}, chosen AS MATERIALIZED (SELECT run_id, key, value FROM snap WHERE run_id IN (8, 46, 100)),
sides AS (SELECT CAST(46 AS BIGINT) AS run_id, key, value AS old, CAST(NULL AS VARCHAR) AS new FROM chosen WHERE run_id = 8
  UNION ALL SELECT CAST(100 AS BIGINT), key, value, NULL FROM chosen WHERE run_id = 8
  UNION ALL SELECT run_id, key, NULL, value FROM chosen WHERE run_id IN (46, 100))
SELECT run_id, key, max(old) AS old, max(new) AS new FROM sides GROUP BY run_id, key HAVING max(old) IS DISTINCT FROM max(new)"""))
def compare_runs(spark, d):
    rows = runs.run_snapshot_rows(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d))
    return runs.compare_runs(rows, [8, 46, 100])


@query(sql(["vstate", "vmetrics", "vcurrent_params", "vartifacts"], f"""
SELECT run_id, 'params' AS section, CAST(NULL AS BIGINT) AS seq, key, value FROM vcurrent_params
UNION ALL SELECT run_id, 'metrics', seq, key, CAST(value AS VARCHAR) FROM vmetrics
UNION ALL SELECT run_id, 'artifacts', seq, path, CAST(size AS VARCHAR) FROM vartifacts
UNION ALL SELECT run_id, 'status', NULL, 'status', status FROM vstate
UNION ALL SELECT run_id, 'status', NULL, 'started_at', {_STAMP.format('started_at')} FROM vstate WHERE started_at IS NOT NULL
UNION ALL SELECT run_id, 'status', NULL, 'ended_at', {_STAMP.format('ended_at')} FROM vstate WHERE ended_at IS NOT NULL
UNION ALL SELECT run_id, 'status', NULL, 'duration_seconds', CAST(duration_seconds AS VARCHAR) FROM vstate WHERE duration_seconds IS NOT NULL"""))
def get_run(spark, d):
    return runs.get_run(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d), b.artifacts(spark, d))


def _logged(spark, d):
    """The metric log appended to in two parts, in folders by run."""
    path = scratch_path(spark, "log")
    for part in (0, 1):
        texts.append_log(b.metrics(spark, d).filter(F.col("seq") % 2 == part), path, bucket_by="run_id")
    return path


@query(sql(["vlatest"], "SELECT run_id, seq, step, ts, key, value FROM vlatest"))
def state_logs(spark, d):
    return runs.latest_metrics(texts.read_log(spark, _logged(spark, d)))


@query(sql(["vmetrics"], "SELECT * FROM vmetrics WHERE run_id IN (8, 46, 100)"))
def state_logs_of_runs(spark, d):
    """Only the folders of the wanted runs are read."""
    return texts.read_log(spark, _logged(spark, d), [8, 46, 100])


@query(sql(["vcurrent_params"], "SELECT * FROM vcurrent_params"))
def current_params(spark, d):
    return runs.current_params(b.params(spark, d))


def _known(spark, d):
    """Runs that exist: users with an even id."""
    return runs.run_state(b.run_events(spark, d)).filter("run_id % 2 = 0")


_KNOWN = ", known AS (SELECT run_id FROM vstate WHERE run_id % 2 = 0)"


@query("""SELECT DISTINCT user_id AS run_id, 0 AS seq, 'start' AS event, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM events""")
def create_runs(spark, d):
    ids = table(spark, d, "events").selectExpr("user_id AS run_id").distinct()
    return runs.create_runs(ids, ts=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query(sql(["vstate", "vparams"], f"""{_KNOWN} SELECT run_id, seq, key, value,
CASE WHEN run_id NOT IN (SELECT run_id FROM known) THEN 'run not found' END AS reason FROM vparams"""))
def log_params(spark, d):
    return runs.log_params(b.params(spark, d), _known(spark, d))


@query(sql(["vstate", "vmetrics"], f"""{_KNOWN} SELECT run_id, seq, CASE WHEN key = 'error' THEN 'step' ELSE key END AS key,
step, ts, value, CASE WHEN run_id NOT IN (SELECT run_id FROM known) THEN 'run not found' WHEN key = 'error' THEN 'reserved metric name' END AS reason FROM vmetrics"""))
def log_metrics(spark, d):
    batch = b.metrics(spark, d).withColumn("key", F.when(F.col("key") == "error", "step").otherwise(F.col("key")))
    return runs.log_metrics(batch, _known(spark, d))


@query(sql(["vstate", "vfiles"], f"""{_KNOWN} SELECT user_id AS run_id, event_id AS seq, 'doc_' || event_id AS source, 'artifacts/doc_' || event_id AS path, size, ts AS logged_at,
CASE WHEN user_id NOT IN (SELECT run_id FROM known) THEN 'run not found' WHEN size IS NULL THEN 'artifact file not found' END AS reason
FROM events LEFT JOIN vfiles ON doc_id = event_id"""))
def log_artifacts(spark, d):
    batch = table(spark, d, "events").selectExpr("user_id AS run_id", "event_id AS seq", "concat('doc_', event_id) AS source", "ts AS logged_at")
    files = b.files(spark, d).selectExpr("concat('doc_', doc_id) AS path", "size", "is_dir")
    return runs.log_artifacts(batch, _known(spark, d), files)


@query(sql(["vstate"], f"""{_KNOWN} SELECT user_id AS run_id, event_id AS seq, event_type AS event, ts,
CASE WHEN user_id NOT IN (SELECT run_id FROM known) THEN 'run not found'
     WHEN event_type NOT IN ('success', 'failed') THEN 'status must be one of: success, failed' END AS reason
FROM (SELECT * REPLACE (CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'failed' ELSE event_type END AS event_type) FROM events)"""))
def finish_runs(spark, d):
    batch = table(spark, d, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq",
        "CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'failed' ELSE event_type END AS status", "ts")
    return runs.finish_runs(batch, _known(spark, d))


@query(sql(["vstate"], "SELECT run_id, FALSE AS deleted FROM vstate WHERE run_id % 3 = 0"))
def delete_runs(spark, d):
    ids = table(spark, d, "events").selectExpr("user_id * 3 AS run_id")
    return runs.delete_runs(b.run_events(spark, d), ids, dry_run=True)


@query(sql(["vstate"], "SELECT * FROM vstate WHERE run_id % 3 <> 0"))
def list_runs_without_deleted(spark, d):
    tombstones = table(spark, d, "events").selectExpr("user_id * 3 AS run_id")
    return runs.run_state(b.run_events(spark, d), tombstones)


_EXPORT_PARAMS = ["Dataset", "data_k", "k_error", "k_purchase", "k_signup"]
_EXPORT_METRICS = ["click", "error", "purchase", "signup", "view"]


@query(sql(["vstate", "vlatest", "vcurrent_params"], "SELECT s.run_id, s.status, s.started_at, s.duration_seconds, " + ", ".join(
    [f"p.\"param_{k}\"" for k in _EXPORT_PARAMS] + [f"m.\"metric_{k}\"" for k in _EXPORT_METRICS]) + " FROM vstate s LEFT JOIN (SELECT run_id, "
    + ", ".join(f"max(value) FILTER (key = '{k}') AS \"param_{k}\"" for k in _EXPORT_PARAMS) + " FROM vcurrent_params GROUP BY run_id) p ON p.run_id = s.run_id LEFT JOIN (SELECT run_id, "
    + ", ".join(f"max(value) FILTER (key = '{k}') AS \"metric_{k}\"" for k in _EXPORT_METRICS) + " FROM vlatest GROUP BY run_id) m ON m.run_id = s.run_id"))
def export_runs(spark, d):
    return runs.export_runs(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d))


def _deleted(spark, d):
    return table(spark, d, "events").selectExpr("user_id * 3 AS run_id")


@query(sql(["vstate", "vmetrics", "vcurrent_params", "vartifacts"], f""", every AS (
SELECT run_id, 'params' AS section, CAST(NULL AS BIGINT) AS seq, key, value FROM vcurrent_params
UNION ALL SELECT run_id, 'metrics', seq, key, CAST(value AS VARCHAR) FROM vmetrics
UNION ALL SELECT run_id, 'artifacts', seq, path, CAST(size AS VARCHAR) FROM vartifacts
UNION ALL SELECT run_id, 'status', NULL, 'status', status FROM vstate
UNION ALL SELECT run_id, 'status', NULL, 'started_at', {_STAMP.format('started_at')} FROM vstate WHERE started_at IS NOT NULL
UNION ALL SELECT run_id, 'status', NULL, 'ended_at', {_STAMP.format('ended_at')} FROM vstate WHERE ended_at IS NOT NULL
UNION ALL SELECT run_id, 'status', NULL, 'duration_seconds', CAST(duration_seconds AS VARCHAR) FROM vstate WHERE duration_seconds IS NOT NULL)
SELECT * FROM every WHERE run_id NOT IN (SELECT user_id * 3 FROM events)"""))
def get_run_without_deleted(spark, d):
    return runs.get_run(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d), b.artifacts(spark, d), tombstones=_deleted(spark, d))


@query(sql(["vstate", "vlatest", "vcurrent_params"], "SELECT s.run_id, s.status, s.started_at, s.duration_seconds, " + ", ".join(
    [f"p.\"param_{k}\"" for k in _EXPORT_PARAMS] + [f"m.\"metric_{k}\"" for k in _EXPORT_METRICS]) + " FROM vstate s LEFT JOIN (SELECT run_id, "
    + ", ".join(f"max(value) FILTER (key = '{k}') AS \"param_{k}\"" for k in _EXPORT_PARAMS) + " FROM vcurrent_params GROUP BY run_id) p ON p.run_id = s.run_id LEFT JOIN (SELECT run_id, "
    + ", ".join(f"max(value) FILTER (key = '{k}') AS \"metric_{k}\"" for k in _EXPORT_METRICS) + " FROM vlatest GROUP BY run_id) m ON m.run_id = s.run_id"
    + " WHERE s.run_id NOT IN (SELECT user_id * 3 FROM events)"))
def export_runs_without_deleted(spark, d):
    return runs.export_runs(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d), _deleted(spark, d), _EXPORT_PARAMS, _EXPORT_METRICS)


@query(sql(["vstate"], """SELECT DISTINCT user_id * 2 AS run_id, 'run not found' AS reason FROM events
WHERE user_id * 2 NOT IN (SELECT run_id FROM vstate) OR user_id * 2 IN (SELECT user_id * 3 FROM events)"""))
def unknown_runs(spark, d):
    """Wanted runs that never were or are deleted."""
    wanted = table(spark, d, "events").selectExpr("user_id * 2 AS run_id")
    return runs.unknown_runs(b.run_events(spark, d), wanted, _deleted(spark, d))


@query(sql(["vstate"], "SELECT run_id, status FROM vstate"))
def export_csv(spark, d):
    from ..session import scratch_path
    from ..sources.tables import export_csv as save, read_table
    path = scratch_path(spark, "runs") + ".csv"
    save(runs.run_state(b.run_events(spark, d)).select("run_id", "status"), path)
    return read_table(spark, path, "run_id BIGINT, status STRING")


@query(sql(["vstate"], """SELECT run_id, CASE WHEN status = 'success' AND run_id IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 150) THEN 'keep' ELSE 'remove' END AS action FROM vstate"""))
def retention_runs(spark, d):
    logged = b.metrics(spark, d).filter("key = 'view' AND value > 150")
    return retention.retention_runs(runs.run_state(b.run_events(spark, d)), logged)


@query(sql(["vstate", "vlatest", "vcurrent_params"], f""", {_SNAPSHOT}
SELECT '2024-02-01' AS snapshot, run_id, count(*) AS row_count, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS byte_count FROM snap
WHERE run_id IN (SELECT run_id FROM vstate WHERE status = 'failed') GROUP BY run_id"""))
def run_snapshot(spark, d):
    rows = runs.run_snapshot_rows(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d))
    failed = runs.run_state(b.run_events(spark, d)).filter("status = 'failed'")
    return mining.run_snapshot(rows, failed, "2024-02-01")[1]


@query(sql(["vstate", "vlatest", "vcurrent_params"], f""", {_SNAPSHOT},
states AS MATERIALIZED (SELECT run_id, status, duration_seconds, updated_at FROM vstate),
recent AS (SELECT run_id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, run_id) AS r FROM states),
pair AS MATERIALIZED (SELECT max(run_id) FILTER (r = 1) AS a, max(run_id) FILTER (r = 2) AS b FROM recent),
placed AS (SELECT key, value, r FROM snap JOIN recent ON recent.run_id = snap.run_id WHERE r <= 2),
compared AS (SELECT key, max(CASE WHEN r = 1 THEN value END) AS old, max(CASE WHEN r = 2 THEN value END) AS new FROM placed GROUP BY key)
SELECT 'project' AS doc, section, item, line FROM (
  SELECT 0 AS section, printf('%012d', i - 1) AS item, line FROM (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
    SELECT ['# EXPERIMENT_REPORT', '', '- Project: project', '- Run Count: ' || (SELECT count(*) FROM states), '', '## Runs'] AS lines))
  UNION ALL SELECT 1, printf('%020d/%s', 1000000000000000000 - coalesce(epoch_us(updated_at), 0), run_id::VARCHAR),
    '- ' || run_id || ': status=' || status || ', duration=' || coalesce(CAST(duration_seconds AS VARCHAR), 'None') FROM states
  UNION ALL SELECT 2, printf('%012d', p), t FROM (VALUES (0, ''), (1, '## Comparison')) v(p, t)
  UNION ALL SELECT 3, key, '- ' || key || ': ' || coalesce(old, 'None') || ' -> ' || coalesce(new, 'None') FROM compared WHERE old IS DISTINCT FROM new
  UNION ALL SELECT 4, printf('%012d', i - 1), line FROM (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
    SELECT ['```mermaid', 'graph TD', '    run1[' || a || '] --> compare', '    run2[' || b || '] --> compare', '```'] AS lines FROM pair)))"""))
def experiment_report(spark, d):
    return cards.experiment_report(b.run_events(spark, d), b.params(spark, d), b.metrics(spark, d), "project")


# --- registry

_REGISTER_SQL = """, batch AS (
  SELECT p_brand AS name, p_partkey AS seq, p_size, p_partkey % 150 AS run_id, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS BIGINT) END AS asked,
         'models/' || p_brand || '/' || p_partkey || {suffix} AS path FROM part),
sized AS (SELECT batch.*, f.size FROM batch LEFT JOIN vmodel_files f ON f.path = batch.path),
autos AS (SELECT *, sum(CASE WHEN asked IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a FROM sized WHERE size IS NOT NULL),
numbered AS (SELECT *, CAST(coalesce(asked, a + max(greatest(2, asked - a)) OVER (PARTITION BY name ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS version FROM autos),
decided AS (SELECT *, CASE WHEN version <= 2 OR row_number() OVER (PARTITION BY name, version ORDER BY seq) > 1 THEN 'version already exists' END AS reason FROM numbered)
SELECT name, version, run_id, path, size, seq, reason FROM decided
UNION ALL SELECT name, asked, run_id, path, NULL, seq, 'model file not found' FROM sized WHERE size IS NULL"""


@query(sql(["vmodel_files"], _REGISTER_SQL.format(suffix=b._sql_pick(b.MODEL_SUFFIXES, "p_size % 5"))))
def register_models(spark, d):
    """A batch of registrations on top of versions 1 and 2 of every brand."""
    part = table(spark, d, "part")
    batch = part.selectExpr("p_brand AS name", "p_partkey AS seq", f"{b._MODEL_PATH} AS path", "p_partkey % 150 AS run_id",
                            "CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS BIGINT) END AS version", "'dev' AS stage",
                            f"{b.minutes('p_partkey')} AS ts")
    existing = part.select(F.col("p_brand").alias("name")).distinct().select(
        "name", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("version"))
    return registry.register_models(batch, existing, b.model_files(spark, d)).select(
        "name", "version", "run_id", "path", "size", "seq", "reason")


@query(sql(["vstage_events"], """SELECT name, version, seq, stage, ts, reason, lag(stage) OVER (PARTITION BY name, version ORDER BY seq) AS from_stage FROM vstage_events"""))
def stage_history(spark, d):
    return registry.stage_history(b.stage_events(spark, d))


@query(sql(["vcurrent_stage"], "SELECT * FROM vcurrent_stage"))
def current_stage(spark, d):
    return registry.current_stage(b.stage_events(spark, d))


@query(sql(["vcurrent_stage", "vversions"], """SELECT v.name, v.version, v.version * 3 + 10 AS seq, 'canary' AS stage, s.stage AS from_stage, CAST(NULL AS VARCHAR) AS error
FROM vversions v JOIN vcurrent_stage s ON s.name = v.name AND s.version = v.version
UNION ALL SELECT name, -version, version * 3 + 10, 'canary', NULL, 'model/version not found' FROM vversions WHERE version % 5 = 0"""))
def promote_models(spark, d):
    versions = b.versions(spark, d)
    batch = versions.selectExpr("name", "version", "version * 3 + 10 AS seq", "'canary' AS stage", f"{b.minutes('version')} AS ts").unionAll(
        versions.filter("version % 5 = 0").selectExpr("name", "-version", "version * 3 + 10", "'canary'", b.minutes("version")))
    return registry.promote_models(batch, b.stage_events(spark, d), versions).select("name", "version", "seq", "stage", "from_stage", "error")


@query(sql(["vcurrent_stage"], """SELECT name, version, 'deprecated' AS stage, stage AS from_stage, 'old ' || version AS reason FROM vcurrent_stage WHERE version % 4 = 0"""))
def deprecate_models(spark, d):
    versions = b.versions(spark, d)
    batch = versions.filter("version % 4 = 0").selectExpr(
        "name", "version", "version * 3 + 10 AS seq", f"{b.minutes('version')} AS ts", "concat('old ', version) AS reason")
    return registry.deprecate_models(batch, b.stage_events(spark, d), versions).select("name", "version", "stage", "from_stage", "reason")


@query(sql(["vtag_log", "vversions"], """SELECT name, version, seq, key, value, CASE WHEN version % 3 = 0 THEN 'model/version not found' END AS error FROM vtag_log"""))
def tag_models(spark, d):
    return registry.tag_models(b.tag_log(spark, d), b.versions(spark, d).filter("version % 3 <> 0")).select(
        "name", "version", "seq", "key", "value", "error")


@query(sql(["vcurrent_tags"], "SELECT * FROM vcurrent_tags"))
def current_tags(spark, d):
    return registry.current_tags(b.tag_log(spark, d))


@query(sql(["vversions"], """SELECT name, version, CAST(NULL AS VARCHAR) AS error FROM vversions WHERE version % 6 = 0
UNION ALL SELECT name, -version, 'model/version not found' FROM vversions WHERE version % 7 = 0"""))
def delete_model_versions(spark, d):
    versions = b.versions(spark, d)
    ids = versions.filter("version % 6 = 0").select("name", "version").unionAll(
        versions.filter("version % 7 = 0").selectExpr("name", "-version"))
    return registry.delete_model_versions(versions, ids)


# Every sixth version is deleted after all events so far; every second of those is registered and staged again later.
_AGAIN = """, gone AS (SELECT name, version, 3 * version + 100 AS dead FROM vversions WHERE version % 6 = 0),
again AS (SELECT name, version, 3 * version + 200 AS seq FROM vversions WHERE version % 12 = 0),
alive AS (SELECT v.name, v.version FROM vversions v WHERE version % 6 <> 0 UNION ALL SELECT name, version FROM again),
stage AS (SELECT name, version, stage FROM vcurrent_stage WHERE version % 6 <> 0 UNION ALL SELECT name, version, 'staging' FROM again),
tags AS (SELECT name, version, count(*) AS n FROM vcurrent_tags WHERE version % 6 <> 0 GROUP BY name, version)
SELECT a.name, a.version, s.stage, coalesce(t.n, 0) AS tag_count FROM alive a JOIN stage s ON s.name = a.name AND s.version = a.version
LEFT JOIN tags t ON t.name = a.name AND t.version = a.version"""


@query(sql(["vversions", "vcurrent_stage", "vcurrent_tags"], _AGAIN))
def reregistered_models(spark, d):
    """Delete, then register the number again: it is visible, without the stage and tags of the deleted one."""
    versions = b.versions(spark, d)
    ids = versions.filter("version % 6 = 0").select("name", "version")
    gone = registry.delete_model_versions(versions, ids, F.col("version") * 3 + 100).filter("error IS NULL")
    again = versions.filter("version % 12 = 0").withColumn("seq", F.col("version") * 3 + 200)
    events = b.stage_events(spark, d)
    events = events.unionByName(again.select("name", "version", "seq", F.lit("staging").alias("stage"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                                             F.lit(None).cast("string").alias("reason")))
    alive = registry.live(versions.unionByName(again), gone).select("name", "version")
    tags = registry.current_tags(b.tag_log(spark, d), gone).groupBy("name", "version").agg(F.count(F.lit(1)).alias("tag_count"))
    return (alive.join(registry.current_stage(events, gone), ["name", "version"]).join(tags, ["name", "version"], "left")
            .select("name", "version", "stage", F.coalesce("tag_count", F.lit(0)).alias("tag_count")))


@query(sql(["vversions", "vcurrent_stage"], """SELECT l.name, l.n AS version_count, l.top AS latest_version, s.stage AS current_stage
FROM (SELECT name, count(*) AS n, max(version) AS top FROM vversions WHERE version % 6 <> 0 GROUP BY name) l
JOIN vcurrent_stage s ON s.name = l.name AND s.version = l.top"""))
def list_models(spark, d):
    versions = b.versions(spark, d)
    return registry.list_models(versions, b.stage_events(spark, d), versions.filter("version % 6 = 0"))


@query(sql(["vversions", "vcurrent_stage", "vmodel_files"], """SELECT v.name, v.version, s.stage, v.run_id, v.path, coalesce(f.size, v.size) AS size, v.framework,
f.size IS NOT NULL AS file_exists, s.deprecation_reason FROM vversions v LEFT JOIN vmodel_files f ON f.path = v.path
LEFT JOIN vcurrent_stage s ON s.name = v.name AND s.version = v.version"""))
def model_versions_with_files(spark, d):
    return registry.model_versions_with_files(b.versions(spark, d), b.model_files(spark, d), b.stage_events(spark, d))


_FACTS = """, info AS (SELECT v.*, s.stage FROM vversions v JOIN vcurrent_stage s ON s.name = v.name AND s.version = v.version),
facts AS (SELECT name, version, 'size' AS field, CAST(size AS VARCHAR) AS value FROM info UNION ALL SELECT name, version, 'stage', stage FROM info
  UNION ALL SELECT name, version, 'framework', framework FROM info UNION ALL SELECT name, version, 'tags.' || key, value FROM vcurrent_tags
  UNION ALL SELECT i.name, i.version, 'latest_run_metrics.' || l.key, CAST(l.value AS VARCHAR) FROM info i JOIN vlatest l ON l.run_id = i.run_id),
pairs AS (SELECT name, version AS version_a, lead(version) OVER (PARTITION BY name ORDER BY version) AS version_b FROM vversions QUALIFY version_b IS NOT NULL),
a AS (SELECT p.*, f.field, f.value FROM pairs p JOIN facts f ON f.name = p.name AND f.version = p.version_a),
b AS (SELECT p.*, f.field, f.value FROM pairs p JOIN facts f ON f.name = p.name AND f.version = p.version_b)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.version_a, b.version_a) AS version_a, coalesce(a.version_b, b.version_b) AS version_b,
       coalesce(a.field, b.field) AS field, a.value AS a, b.value AS b
FROM a FULL JOIN b ON a.name = b.name AND a.version_a = b.version_a AND a.field = b.field"""


def _info(spark, d):
    return b.versions(spark, d).join(registry.current_stage(b.stage_events(spark, d)), ["name", "version"])


@query(sql(["vversions", "vcurrent_stage", "vcurrent_tags", "vlatest"], _FACTS))
def compare_model_versions(spark, d):
    """Every version of a model with the next one."""
    from ..operators.ranks import previous_in_group
    pairs = previous_in_group(b.versions(spark, d).select("name", "version"), ["name"], "version", "version", "version_a")
    pairs = pairs.filter("version_a IS NOT NULL").withColumnRenamed("version", "version_b")
    facts = registry.model_facts(_info(spark, d), registry.current_tags(b.tag_log(spark, d)), runs.latest_metrics(b.metrics(spark, d)))
    return registry.compare_model_versions(facts, pairs)


@query(sql(["vversions", "vstate", "vcurrent_params"], """SELECT v.name, v.version, v.run_id, s.status AS run_status, p.key || '=' || p.value AS dataset_hint FROM vversions v
LEFT JOIN vstate s ON s.run_id = v.run_id LEFT JOIN (SELECT * FROM vcurrent_params WHERE lower(key) LIKE '%data%') p ON p.run_id = v.run_id"""))
def model_lineage(spark, d):
    return registry.model_lineage(b.versions(spark, d), runs.run_state(b.run_events(spark, d)), runs.current_params(b.params(spark, d)))


@query(sql(["vversions", "vcurrent_stage", "vcurrent_tags", "vcurrent_params"], """, info AS (
  SELECT v.*, s.stage FROM vversions v JOIN vcurrent_stage s ON s.name = v.name AND s.version = v.version)
SELECT doc, section, item, line FROM (
  SELECT name || '/' || version AS doc, 0 AS section, printf('%012d', i - 1) AS item, line FROM (
    SELECT name, version, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT name, version,
      ['# MODEL_CARD', '', '- Name: ' || name, '- Version: ' || version, '- Stage: ' || stage, '- Framework: ' || framework, '- Path: ' || path,
       '- Run ID: ' || run_id, '', '## Tags'] AS lines FROM info))
  UNION ALL SELECT name || '/' || version, 1, key, '- ' || key || ': ' || value FROM vcurrent_tags
  UNION ALL SELECT name || '/' || version, 2, printf('%012d', p), t FROM info, (VALUES (0, ''), (1, '## Dataset Hints')) v(p, t)
  UNION ALL SELECT i.name || '/' || i.version, 3, p.key || '=' || p.value, '- ' || p.key || '=' || p.value FROM info i
    JOIN vcurrent_params p ON p.run_id = i.run_id WHERE lower(p.key) LIKE '%data%')"""))
def model_card(spark, d):
    hints = registry.model_lineage(b.versions(spark, d), runs.run_state(b.run_events(spark, d)), runs.current_params(b.params(spark, d)))
    return cards.model_card(_info(spark, d), registry.current_tags(b.tag_log(spark, d)), hints)


@query(sql(["vrun_events"], "SELECT * FROM vrun_events"))
def state_logs_once(spark, d):
    """Events appended in batches of which one is repeated, one replaces what a broken attempt left, and two were put together."""
    path, events = scratch_path(spark, "once"), b.run_events(spark, d)
    part = lambda k: events.filter(F.col("seq") % 3 == k)
    texts.append_once(part(0), path, "first")
    texts.append_once(part(0), path, "first")
    texts.compact(spark, path, "old")
    part(2).write.parquet(f"{path}/batch=second")
    texts.append_once(part(1), path, "second")
    texts.append_once(part(2), path, "third")
    return texts.read_committed(spark, path).drop("batch")
