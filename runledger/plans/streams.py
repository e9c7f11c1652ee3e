"""Queries: the streaming operators drained over the given tables, equal to their batch twins."""

from pyspark.sql import functions as F

from ..operators import drift
from ..session import scratch_path
from ..streaming import logs
from .bindings import sql, table
from .quality import _ks_sql
from .registry import query


def _stored(folder, name):
    """A pattern that names one table, be it a file or a folder: a stream source takes no plain file."""
    return f"{folder}/{name}.parque[t]"


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return logs.event_time(logs.read_log_stream(spark, _stored(d, "events"), schema))


def _drain(spark, stream, mode="append"):
    return logs.run_to_table(stream, scratch_path(spark, "stream"), scratch_path(spark, "progress"), mode)


def _metrics(spark, d):
    return _events(spark, d).selectExpr("user_id AS run_id", "event_id AS seq", "event_id AS step", "ts", "event_type AS key", "value")


@query(sql(["vlatest"], "SELECT run_id, seq, step, ts, key, value FROM vlatest"))
def stream_latest_metrics(spark, d):
    entries = _metrics(spark, d).select("run_id", "seq", "step", "ts", F.create_map("key", "value").alias("metrics"))
    changed = _drain(spark, logs.stream_latest_metrics(entries), "update")
    return logs.latest_rows(changed).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT date_trunc('day', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events
GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_metric_windows(spark, d):
    """Windows the watermark has closed; the newest ones are still open when the log ends."""
    done = _drain(spark, logs.stream_metric_windows(_metrics(spark, d)))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 4).alias("total"), "low", "high")


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT min(ts) AS start, user_id AS run_id, count(*) AS n FROM numbered GROUP BY user_id, session
HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_run_sessions(spark, d):
    done = _drain(spark, logs.stream_run_sessions(_metrics(spark, d)))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "n")


@query("SELECT DISTINCT md5(text) AS md5 FROM documents")
def stream_dedup(spark, d):
    schema = table(spark, d, "documents").schema
    docs = logs.read_log_stream(spark, _stored(d, "documents"), schema).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.pmod("doc_id", F.lit(1000)) * 1000000).alias("ts"), F.col("text").alias("content"))
    return _drain(spark, logs.stream_dedup(docs)).select("md5")


_SIDES = "SELECT value, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT value, 1 FROM events"


@query(f"""WITH {_ks_sql(_SIDES, ['value'])} SELECT col AS "column", round(stat, 12) AS ks_statistic, p < 0.05 AS drift_detected FROM tested""")
def stream_drift(spark, d):
    reference = table(spark, d, "events").filter("event_id % 2 = 0").select("value")
    path = scratch_path(spark, "drift")
    writer = logs.stream_drift(_events(spark, d).select("value"), reference, ["value"], path)
    writer.option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("column", F.round("ks_statistic", 12).alias("ks_statistic"), "drift_detected")


_BY_DAY = "SELECT date_trunc('day', ts) AS day, * FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""WITH w AS ({_BY_DAY}), ref AS (SELECT value, event_type FROM events WHERE event_id % 2 = 0), days AS (SELECT DISTINCT day FROM w),
v AS (SELECT day, value, 1 AS r, 0 AS c FROM days, ref UNION ALL SELECT day, value, 0, 1 FROM w), g AS (SELECT day, value, sum(r) AS r, sum(c) AS c FROM v GROUP BY day, value),
u AS (SELECT day, sum(r) OVER o AS r, sum(c) OVER o AS c, sum(r) OVER (PARTITION BY day) AS n, sum(c) OVER (PARTITION BY day) AS m FROM g
      WINDOW o AS (PARTITION BY day ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT day, max(abs(r::DOUBLE / n - c::DOUBLE / m)) AS ks FROM u GROUP BY day),
cat AS (SELECT day, event_type, sum(r) AS r, sum(c) AS c FROM (SELECT day, event_type, 1 AS r, 0 AS c FROM days, ref UNION ALL SELECT day, event_type, 0, 1 FROM w) GROUP BY day, event_type),
l1 AS (SELECT day, sum(abs(r::DOUBLE / n - c::DOUBLE / m)) AS d FROM (SELECT *, sum(r) OVER (PARTITION BY day) AS n, sum(c) OVER (PARTITION BY day) AS m FROM cat) GROUP BY day)
SELECT day AS start, 'value' AS "column", round(ks, 12) AS ks_statistic, CAST(NULL AS DOUBLE) AS frequency_distance FROM ks
UNION ALL SELECT day, 'event_type', NULL, round(d, 9) FROM l1""")
def stream_drift_windows(spark, d):
    """Days of the event stream against its even events: counts kept in state, judged when the watermark has closed the day."""
    reference = table(spark, d, "events").filter("event_id % 2 = 0").select("value", "event_type")
    plan = drift.plan_columns(reference.schema, reference.schema)
    windows = _drain(spark, logs.stream_value_windows(_events(spark, d), list(plan)))
    found = drift.window_drift(drift.value_counts(reference, plan), windows, ["start"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "column", F.round("ks_statistic", 12).alias("ks_statistic"),
                        F.round("frequency_distance", 9).alias("frequency_distance"))


@query(sql(["vstate"], "SELECT * FROM vstate WHERE run_id % 3 <> 0"))
def stream_run_states(spark, d):
    """Run states kept by a stateful operator over the event stream; runs that are a multiple of three are deleted as they come."""
    names = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' END")
    events = _events(spark, d).filter(names.isNotNull()).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), names.alias("event"), "ts")
    deleted = F.expr("CASE WHEN run_id % 3 = 0 THEN array(event, 'deleted') ELSE array(event) END")
    changes = _drain(spark, logs.stream_run_states(events.withColumn("event", F.explode(deleted))), "update")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at", "updated_at")}
    return logs.latest_states(changes).withColumns(times)


@query("""SELECT b.start, event_type AS key, count(*) AS n, min(value) AS low, max(value) AS high
FROM events, (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 1 DAY, max(ts), INTERVAL 6 HOUR)) AS start FROM events) b
WHERE ts >= b.start AND ts < b.start + INTERVAL 1 DAY AND b.start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY b.start, event_type""")
def stream_metric_sliding_windows(spark, d):
    """Days that begin every six hours."""
    done = _drain(spark, logs.stream_metric_windows(_metrics(spark, d), "1 day", "6 hours"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", "low", "high")
