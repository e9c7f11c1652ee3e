"""Queries: lineage and stage graphs."""

from pyspark.sql import functions as F

from ..operators import lineage, stages
from . import bindings as b
from .bindings import sql, table
from .registry import query

# Ancestors by recursion over distinct pairs: UNION (not UNION ALL) ends on cycles.
_REACHED = """roots AS (SELECT 'order:' || o_orderkey AS root FROM orders UNION ALL SELECT 'part:' || p_partkey FROM part),
reached AS (SELECT root, root AS node FROM roots UNION SELECT r.root, e.input FROM reached r JOIN vlineage_edges e ON e.output = r.node)"""


def _recursive(views, body):
    return sql(views, f", {_REACHED} {body}").replace("WITH ", "WITH RECURSIVE ", 1)


@query(sql([], """SELECT 'x' || p_partkey AS output, CASE WHEN p_size % 5 = 0 THEN 'inputs must not be empty'
 WHEN p_size % 7 = 0 THEN 'run_id must not be empty' END AS reason FROM part WHERE p_size % 4 <> 0
UNION ALL SELECT '  ', 'output must not be empty' FROM part WHERE p_size % 4 = 0"""))
def record_lineage(spark, d):
    batch = table(spark, d, "part").selectExpr(
        "p_partkey AS seq", "CASE WHEN p_size % 4 = 0 THEN '  ' ELSE concat('x', p_partkey) END AS output",
        "CASE WHEN p_size % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('a') END AS inputs",
        "CASE WHEN p_size % 7 = 0 THEN '' ELSE 'run' END AS run_id")
    return lineage.record_lineage(batch).select("output", "reason")


@query(_recursive(["vlineage_edges"], "SELECT root, node FROM reached"))
def ancestors(spark, d):
    return lineage.ancestors(b.lineage(spark, d), b.lineage_roots(spark, d))


@query(_recursive(["vlineage_edges"], """SELECT r.root, l.seq, l.output, array_to_string(l.inputs, ',') AS inputs, l.run_id, l.ts
FROM reached r JOIN vlineage l ON l.output = r.node"""))
def provenance(spark, d):
    return lineage.provenance(b.lineage(spark, d), b.lineage_roots(spark, d)).withColumn("inputs", F.concat_ws(",", "inputs"))


@query(_recursive(["vlineage_edges"], "SELECT root, node AS artifact FROM reached WHERE node NOT IN (SELECT output FROM vlineage)"))
def source_artifacts(spark, d):
    return lineage.source_artifacts(b.lineage(spark, d), b.lineage_roots(spark, d))


@query(sql(["vlineage_edges"], """SELECT artifact, 'artifact' AS type, coalesce(arg_max(ts, seq) FILTER (made), arg_min(ts, seq) FILTER (NOT made)) AS last_updated
FROM (SELECT output AS artifact, seq, ts, TRUE AS made FROM vlineage UNION ALL SELECT input, seq, ts, FALSE FROM vlineage_edges) GROUP BY artifact"""))
def lineage_artifacts(spark, d):
    return lineage.lineage_artifacts(b.lineage(spark, d))


@query(sql(["vlineage_edges", "vlineage_files"], """SELECT output, input AS missing_input, run_id FROM vlineage_edges
WHERE input NOT IN (SELECT path FROM vlineage_files)"""))
def lineage_integrity(spark, d):
    return lineage.lineage_integrity(b.lineage(spark, d), b.lineage_files(spark, d))


@query(_recursive(["vlineage_edges"], """, arrows AS (SELECT r.root, e.seq, e.output, e.input FROM reached r JOIN vlineage_edges e ON e.output = r.node)
SELECT root, 0 AS section, CAST(NULL AS BIGINT) AS seq, '' AS item, 'graph TD' AS line FROM roots
UNION ALL SELECT root, 1, NULL, item, '    ' || item || '[' || item || ']' FROM (SELECT root, output AS item FROM arrows UNION SELECT root, input FROM arrows)
UNION ALL SELECT root, 2, seq, input, '    ' || input || ' --> ' || output FROM arrows"""))
def lineage_mermaid(spark, d):
    return lineage.lineage_mermaid(b.lineage(spark, d), b.lineage_roots(spark, d))


# --- stages

@query(sql(["vstage_edges"], "SELECT * FROM vstage_edges"))
def stage_edges(spark, d):
    return stages.stage_edges(b.stages(spark, d))


# Reachability from each stage back to itself.
_CYCLIC = """walk AS (SELECT pipeline, src AS start, dst AS node FROM vstage_edges
  UNION SELECT w.pipeline, w.start, e.dst FROM walk w JOIN vstage_edges e ON e.pipeline = w.pipeline AND e.src = w.node),
cyclic AS (SELECT DISTINCT pipeline FROM walk WHERE start = node)"""


@query(sql(["vstage_edges"], f", {_CYCLIC} SELECT pipeline FROM cyclic").replace("WITH ", "WITH RECURSIVE ", 1))
def has_cycle(spark, d):
    return stages.has_cycle(stages.stage_edges(b.stages(spark, d)))


@query(sql(["vstage_edges", "vstage_files"], f""", {_CYCLIC}
SELECT pipeline, stage, 'missing cmd' AS error, CAST(NULL AS VARCHAR) AS path FROM vstages WHERE cmd IS NULL OR cmd = ''
UNION ALL SELECT pipeline, stage, 'missing dependency', dep FROM (SELECT pipeline, stage, unnest(deps) AS dep FROM vstages) WHERE dep NOT IN (SELECT path FROM vstage_files)
UNION ALL SELECT pipeline, NULL, 'circular dependency detected', NULL FROM cyclic""").replace("WITH ", "WITH RECURSIVE ", 1))
def validate_stages(spark, d):
    return stages.validate_pipelines(b.stages(spark, d), b.stage_files(spark, d))


@query(sql(["vstages", "vstage_files"], """, o AS (SELECT s.pipeline, s.stage, min(f.mtime) AS t, count(*) FILTER (f.path IS NULL) AS lacking,
  string_agg(s.art, ',' ORDER BY s.art) FILTER (f.path IS NULL) AS missing
  FROM (SELECT pipeline, stage, unnest(outs) AS art FROM vstages) s LEFT JOIN vstage_files f ON f.path = s.art GROUP BY s.pipeline, s.stage),
i AS (SELECT s.pipeline, s.stage, max(f.mtime) AS t FROM (SELECT pipeline, stage, unnest(deps) AS art FROM vstages) s LEFT JOIN vstage_files f ON f.path = s.art GROUP BY s.pipeline, s.stage)
SELECT o.pipeline, o.stage, CASE WHEN lacking > 0 OR i.t > o.t THEN 'stale' ELSE 'up-to-date' END AS status,
  CASE WHEN lacking > 0 THEN 'missing_outputs' WHEN i.t > o.t THEN 'deps_newer_than_outs' END AS reason, missing AS missing_outputs, CAST(lacking AS INTEGER) AS missing_count
FROM o LEFT JOIN i ON i.pipeline = o.pipeline AND i.stage = o.stage"""))
def stage_status(spark, d):
    return stages.pipeline_status(b.stages(spark, d), b.stage_files(spark, d))


@query(sql(["vstages"], """SELECT pipeline, stage, ord, CASE WHEN taken THEN 'stage already exists' END AS reason FROM (
  SELECT pipeline, CASE WHEN ord % 2 = 0 THEN stage ELSE 'new_' || (ord // 4) END AS stage, ord,
         ord % 2 = 0 OR row_number() OVER (PARTITION BY pipeline, CASE WHEN ord % 2 = 0 THEN stage ELSE 'new_' || (ord // 4) END ORDER BY ord) > 1 AS taken FROM vstages)"""))
def add_stage(spark, d):
    held = b.stages(spark, d)
    batch = held.withColumn("stage", F.expr("CASE WHEN ord % 2 = 0 THEN stage ELSE concat('new_', ord div 4) END"))
    return stages.add_stage(batch, held).select("pipeline", "stage", "ord", "reason")


@query(sql(["vstages"], """, gone AS (SELECT pipeline, stage AS removed, outs FROM vstages WHERE ord = 1 UNION ALL SELECT DISTINCT pipeline, 'ghost', NULL FROM vstages),
hit AS (SELECT DISTINCT g.pipeline, g.removed, s.stage AS dependent FROM gone g JOIN vstages s ON s.pipeline = g.pipeline AND s.stage <> g.removed AND list_has_any(s.deps, g.outs))
SELECT g.pipeline, g.removed, g.outs IS NOT NULL AS found, h.dependent FROM gone g LEFT JOIN hit h ON h.pipeline = g.pipeline AND h.removed = g.removed"""))
def remove_stage(spark, d):
    held = b.stages(spark, d)
    removals = held.filter("ord = 1").select("pipeline", "stage").unionAll(
        held.select("pipeline").distinct().withColumn("stage", F.lit("ghost")))
    return stages.remove_stage(held, removals)


_DIAGRAM = """SELECT DISTINCT pipeline, 0 AS section, CAST(0 AS BIGINT) AS ord, '' AS item, 'graph TD' AS line FROM vstages
UNION ALL SELECT pipeline, 1, ord, stage, '    ' || stage || '[' || stage || ']' FROM vstages
UNION ALL SELECT e.pipeline, 2, s.ord, e.dst, '    ' || e.src || ' --> ' || e.dst FROM vstage_edges e JOIN vstages s ON s.pipeline = e.pipeline AND s.stage = e.src"""


@query(sql(["vstage_edges"], _DIAGRAM))
def stage_mermaid(spark, d):
    return stages.pipeline_mermaid(b.stages(spark, d))


@query(sql(["vstage_edges"], f""", diagram AS ({_DIAGRAM}), n AS (SELECT pipeline, count(*) AS c FROM vstages GROUP BY pipeline)
SELECT pipeline, 0 AS section, CAST(o AS BIGINT) AS ord, '' AS item, line FROM (
  SELECT pipeline, unnest([0, 1, 2, 3]) AS o, unnest(['# PIPELINE', '- Pipeline File: ' || pipeline, '- Stage Count: ' || c, '## Stages']) AS line FROM n)
UNION ALL SELECT pipeline, 1, ord, unnest(['0', '1', '2', '3']), unnest(['### ' || stage, '- cmd: ' || cmd,
  '- deps: [' || CASE WHEN len(deps) = 0 THEN '' ELSE '''' || deps[1] || '''' END || ']', '- outs: [''' || outs[1] || ''']']) FROM vstages
UNION ALL SELECT pipeline, 2, 0, '', '## Graph' FROM n UNION ALL SELECT pipeline, section + 3, ord, item, line FROM diagram"""))
def stage_docs(spark, d):
    return stages.pipeline_docs(b.stages(spark, d))
