"""The operators' inputs, derived from the given tables.

Each relation exists twice: as a DataFrame here and as a common table expression of the
same name in ``VIEWS``, so that queries and their SQL counterparts start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import lines_of, suffix
from ..functions.fixed_values import LAYOUTS
from ..session import local_table, spread

EXTENSIONS = [".csv", ".parquet", ".pt", ".onnx", ".py", ".md", ".log", ".json", ".png", ""]
MODEL_SUFFIXES = [".pt", ".onnx", ".pkl", ".safetensors", ".bin"]
STAGE_NAMES = ["dev", "staging", "prod", "archived"]
SQL_LINE_BREAK = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'"

VIEWS: dict[str, str] = {}


def _pick(names: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in names)}), CAST({index} + 1 AS INT))"


def _sql_pick(names: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({index} + 1 AS INT))"


def minutes(expression: str) -> str:
    """2024-01-01 plus so many minutes, as TIMESTAMP_NTZ (Spark SQL text)."""
    return f"CAST(timestamp_micros(1704067200000000 + ({expression}) * 60000000) AS TIMESTAMP_NTZ)"


def sql_minutes(expression: str) -> str:
    return f"make_timestamp(1704067200000000 + CAST({expression} AS BIGINT) * 60000000)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- file catalog: every document is a file source/lang/doc_<id><ext>

VIEWS["vfiles"] = f"""
  SELECT source || '/' || lang || '/doc_' || doc_id || ext AS path, 'doc_' || doc_id || ext AS name, ext,
         FALSE AS is_dir, CAST(strlen(text) AS BIGINT) AS size, {sql_minutes('doc_id')} AS mtime, text AS content,
         source, lang, doc_id
  FROM (SELECT *, {_sql_pick(EXTENSIONS, 'doc_id % 10')} AS ext FROM documents)"""


def files(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("ext", F.expr(_pick(EXTENSIONS, "doc_id % 10")))
    return docs.selectExpr(
        "concat(source, '/', lang, '/doc_', doc_id, ext) AS path", "concat('doc_', doc_id, ext) AS name", "ext",
        "FALSE AS is_dir", "CAST(octet_length(text) AS BIGINT) AS size", f"{minutes('doc_id')} AS mtime",
        "text AS content", "source", "lang", "doc_id")


VIEWS["vtree"] = """
  SELECT path, name, ext, is_dir, size, mtime FROM vfiles
  UNION ALL SELECT source, source, '', TRUE, 0, NULL FROM (SELECT DISTINCT source FROM vfiles)
  UNION ALL SELECT source || '/' || lang, lang, '', TRUE, 0, NULL FROM (SELECT DISTINCT source, lang FROM vfiles)"""


def tree(spark, folder) -> DataFrame:
    """Files and the folders they lie in, without contents."""
    listed = files(spark, folder)
    columns = ["path", "name", "ext", "is_dir", "size", "mtime"]
    pairs = listed.select("source", "lang").distinct()
    empty = ["'' AS ext", "TRUE AS is_dir", "CAST(0 AS BIGINT) AS size", "CAST(NULL AS TIMESTAMP_NTZ) AS mtime"]
    tops = pairs.select("source").distinct().selectExpr("source AS path", "source AS name", *empty)
    subs = pairs.selectExpr("concat(source, '/', lang) AS path", "lang AS name", *empty)
    return listed.select(*columns).unionAll(tops).unionAll(subs)


# --- run logs: every event is a metric entry and a parameter, some change the run's state

EVENT_STATES = {"signup": "start", "purchase": "success", "error": "failed"}
PARAM_KEY = "CASE event_type WHEN 'view' THEN 'data_k' WHEN 'click' THEN 'Dataset' ELSE concat('k_', event_type) END"
_STATE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_STATES.items()) + " END"

VIEWS["vmetrics"] = """
  SELECT user_id AS run_id, event_id AS seq, event_id AS step, ts, event_type AS key, value FROM events"""
VIEWS["vparams"] = f"""
  SELECT user_id AS run_id, event_id AS seq, {PARAM_KEY} AS key, regexp_extract(props, '"k": ([0-9]+)', 1) AS value
  FROM events"""
VIEWS["vrun_events"] = f"""
  SELECT user_id AS run_id, event_id AS seq, {_STATE} AS event, ts FROM events
  WHERE event_type IN ('signup', 'purchase', 'error')"""
VIEWS["vartifacts"] = """
  SELECT user_id AS run_id, event_id AS seq, 'out/' || event_type AS path, event_id * 10 AS size, ts AS logged_at
  FROM events WHERE event_type = 'purchase'"""


def metrics(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq", "event_id AS step", "ts", "event_type AS key", "value")


def params(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq", f"{PARAM_KEY} AS key",
        """regexp_extract(props, '"k": ([0-9]+)', 1) AS value""")


def run_events(spark, folder) -> DataFrame:
    return table(spark, folder, "events").filter(F.col("event_type").isin(list(EVENT_STATES))).selectExpr(
        "user_id AS run_id", "event_id AS seq", f"{_STATE} AS event", "ts")


def artifacts(spark, folder) -> DataFrame:
    return table(spark, folder, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id AS run_id", "event_id AS seq", "concat('out/', event_type) AS path", "event_id * 10 AS size", "ts AS logged_at")


# Folded state in SQL, shared by many counterparts.
VIEWS["vstate"] = """
  SELECT run_id, status, started_at, ended_at,
         CASE WHEN started_at IS NOT NULL AND ended_at IS NOT NULL
              THEN greatest(0.0::DOUBLE, (epoch_us(ended_at) - epoch_us(started_at))::DOUBLE / 1e6::DOUBLE) END AS duration_seconds,
         coalesce(ended_at, started_at) AS updated_at
  FROM (SELECT run_id, CASE arg_max(event, seq) WHEN 'start' THEN 'running' ELSE arg_max(event, seq) END AS status,
               min(ts) FILTER (event = 'start') AS started_at, arg_max(ts, seq) FILTER (event <> 'start') AS ended_at
        FROM vrun_events GROUP BY run_id)"""
VIEWS["vcurrent_params"] = """
  SELECT run_id, key, arg_max(value, seq) AS value FROM vparams GROUP BY run_id, key"""
VIEWS["vlatest"] = """
  SELECT * FROM vmetrics QUALIFY seq = max(seq) OVER (PARTITION BY run_id)"""


# --- model registry: every part is a registered version of its brand

VIEWS["vmodel_files"] = f"""
  SELECT 'models/' || p_brand || '/' || p_partkey || {_sql_pick(MODEL_SUFFIXES, 'p_size % 5')} AS path, FALSE AS is_dir,
         CAST(p_size AS BIGINT) * 1024 AS size FROM part WHERE p_partkey % 17 <> 0"""
VIEWS["vversions"] = f"""
  SELECT p_brand AS name, p_partkey + 1 AS version, p_partkey % 150 AS run_id,
         'models/' || p_brand || '/' || p_partkey || {_sql_pick(MODEL_SUFFIXES, 'p_size % 5')} AS path,
         CAST(p_size AS BIGINT) * 1000 AS size,
         CASE p_size % 5 WHEN 0 THEN 'pytorch' WHEN 1 THEN 'onnx' WHEN 2 THEN 'sklearn' WHEN 3 THEN 'safetensors'
              ELSE 'unknown' END AS framework, p_partkey AS seq
  FROM part"""
VIEWS["vstage_events"] = f"""
  SELECT p_brand AS name, p_partkey + 1 AS version, p_partkey * 3 AS seq, {_sql_pick(STAGE_NAMES, 'p_size % 4')} AS stage,
         {sql_minutes('p_partkey')} AS ts, CAST(NULL AS VARCHAR) AS reason FROM part
  UNION ALL SELECT p_brand, p_partkey + 1, p_partkey * 3 + 1, 'production', {sql_minutes('p_partkey + 1')}, NULL
  FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_brand, p_partkey + 1, p_partkey * 3 + 2, 'deprecated', {sql_minutes('p_partkey + 2')}, 'size ' || p_size
  FROM part WHERE p_size % 7 = 0"""
VIEWS["vtag_log"] = """
  SELECT p_brand AS name, p_partkey + 1 AS version, p_partkey * 3 AS seq, 'type' AS key, p_type AS value FROM part
  UNION ALL SELECT p_brand, p_partkey + 1, p_partkey * 3 + 1, 'size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_brand, p_partkey + 1, p_partkey * 3 + 2, 'type', lower(p_type) FROM part WHERE p_size % 2 = 0"""
VIEWS["vcurrent_stage"] = """
  SELECT name, version, arg_max(stage, seq) AS stage,
         list_extract(list(reason ORDER BY seq DESC), 1) AS deprecation_reason FROM vstage_events GROUP BY name, version"""
VIEWS["vcurrent_tags"] = """
  SELECT name, version, key, arg_max(value, seq) AS value FROM vtag_log GROUP BY name, version, key"""

_MODEL_PATH = f"concat('models/', p_brand, '/', p_partkey, {_pick(MODEL_SUFFIXES, 'p_size % 5')})"


def model_files(spark, folder) -> DataFrame:
    return table(spark, folder, "part").filter("p_partkey % 17 <> 0").selectExpr(
        f"{_MODEL_PATH} AS path", "FALSE AS is_dir", "CAST(p_size AS BIGINT) * 1024 AS size")


def versions(spark, folder) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_brand AS name", "p_partkey + 1 AS version", "p_partkey % 150 AS run_id", f"{_MODEL_PATH} AS path",
        "CAST(p_size AS BIGINT) * 1000 AS size",
        "CASE p_size % 5 WHEN 0 THEN 'pytorch' WHEN 1 THEN 'onnx' WHEN 2 THEN 'sklearn' WHEN 3 THEN 'safetensors' "
        "ELSE 'unknown' END AS framework", "p_partkey AS seq")


def stage_events(spark, folder) -> DataFrame:
    part = table(spark, folder, "part")
    base = ["p_brand AS name", "p_partkey + 1 AS version"]
    first = part.selectExpr(*base, "p_partkey * 3 AS seq", f"{_pick(STAGE_NAMES, 'p_size % 4')} AS stage",
                            f"{minutes('p_partkey')} AS ts", "CAST(NULL AS STRING) AS reason")
    promoted = part.filter("p_size % 3 = 0").selectExpr(
        *base, "p_partkey * 3 + 1 AS seq", "'production' AS stage", f"{minutes('p_partkey + 1')} AS ts",
        "CAST(NULL AS STRING) AS reason")
    dropped = part.filter("p_size % 7 = 0").selectExpr(
        *base, "p_partkey * 3 + 2 AS seq", "'deprecated' AS stage", f"{minutes('p_partkey + 2')} AS ts",
        "concat('size ', p_size) AS reason")
    return first.unionAll(promoted).unionAll(dropped)


def tag_log(spark, folder) -> DataFrame:
    part = table(spark, folder, "part")
    base = ["p_brand AS name", "p_partkey + 1 AS version"]
    return (part.selectExpr(*base, "p_partkey * 3 AS seq", "'type' AS key", "p_type AS value")
            .unionAll(part.selectExpr(*base, "p_partkey * 3 + 1", "'size'", "CAST(p_size AS STRING)"))
            .unionAll(part.filter("p_size % 2 = 0").selectExpr(*base, "p_partkey * 3 + 2", "'type'", "lower(p_type)")))


# --- lineage: order <- customer <- nation <- region; parts in rings of eight, each from a supplier

VIEWS["vlineage"] = f"""
  SELECT o_orderkey * 4 AS seq, 'order:' || o_orderkey AS output, ['customer:' || o_custkey] AS inputs,
         'run' || (o_orderkey % 150) AS run_id, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
  UNION ALL SELECT c_custkey * 4 + 1, 'customer:' || c_custkey, ['nation:' || c_nationkey], 'run' || (c_custkey % 150),
         {sql_minutes('c_custkey')} FROM customer
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, 'nation:' || n_nationkey, ['region:' || n_regionkey], 'run0',
         {sql_minutes('n_nationkey')} FROM nation
  UNION ALL SELECT p_partkey * 4 + 3, 'part:' || p_partkey,
         ['part:' || (p_partkey - p_partkey % 8 + (p_partkey + 1) % 8), 'supplier:' || (p_partkey % 200)],
         'run' || (p_partkey % 150), {sql_minutes('p_partkey')} FROM part"""
VIEWS["vlineage_edges"] = """
  SELECT seq, output, unnest(inputs) AS input, run_id, ts FROM vlineage"""
VIEWS["vlineage_files"] = """
  SELECT 'customer:' || c_custkey AS path FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey FROM part"""


def lineage(spark, folder) -> DataFrame:
    def records(name, key, prefix, inputs, run, ts, slot):
        return table(spark, folder, name).selectExpr(
            f"CAST({key} AS BIGINT) * 4 + {slot} AS seq", f"concat('{prefix}:', {key}) AS output", f"array({inputs}) AS inputs",
            f"{run} AS run_id", f"{ts} AS ts")

    def run(key):
        return f"concat('run', {key} % 150)"

    return (records("orders", "o_orderkey", "order", "concat('customer:', o_custkey)", run("o_orderkey"), "o_orderdate", 0)
            .unionAll(records("customer", "c_custkey", "customer", "concat('nation:', c_nationkey)", run("c_custkey"),
                              minutes("c_custkey"), 1))
            .unionAll(records("nation", "n_nationkey", "nation", "concat('region:', n_regionkey)", "'run0'",
                              minutes("n_nationkey"), 2))
            .unionAll(records("part", "p_partkey", "part",
                              "concat('part:', p_partkey - p_partkey % 8 + (p_partkey + 1) % 8), "
                              "concat('supplier:', p_partkey % 200)", run("p_partkey"), minutes("p_partkey"), 3)))


def lineage_roots(spark, folder) -> DataFrame:
    """Everything recorded as an output of an order or part."""
    orders = table(spark, folder, "orders").selectExpr("concat('order:', o_orderkey) AS root")
    return orders.unionAll(table(spark, folder, "part").selectExpr("concat('part:', p_partkey) AS root"))


def lineage_files(spark, folder) -> DataFrame:
    parts = [("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"),
             ("part", "p_partkey")]
    frames = [table(spark, folder, name).selectExpr(f"concat('{name}:', {key}) AS path") for name, key in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


# --- stage graphs: a conversation is a chain of stages; every tenth one is closed to a ring

VIEWS["vstages"] = """
  SELECT 'c' || c.conv_id AS pipeline, turn AS ord, 'turn_' || turn AS stage, CASE WHEN turn % 5 = 4 THEN '' ELSE role END AS cmd,
         CASE WHEN turn > 0 THEN ['c' || c.conv_id || '/t' || (turn - 1)]
              WHEN c.conv_id % 10 = 0 THEN ['c' || c.conv_id || '/t' || last] ELSE CAST([] AS VARCHAR[]) END AS deps,
         ['c' || c.conv_id || '/t' || turn] AS outs
  FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id"""
VIEWS["vstage_files"] = f"""
  SELECT 'c' || conv_id || '/t' || turn AS path, FALSE AS is_dir, {sql_minutes('(conv_id * 31 + turn * 17) % 100')} AS mtime
  FROM conversations WHERE (conv_id + turn) % 7 <> 0"""
VIEWS["vstage_edges"] = """
  SELECT DISTINCT n.pipeline, p.src, n.dst
  FROM (SELECT pipeline, stage AS dst, unnest(deps) AS artifact FROM vstages) n
  JOIN (SELECT pipeline, artifact, arg_max(stage, ord) AS src
        FROM (SELECT pipeline, ord, stage, unnest(outs) AS artifact FROM vstages) GROUP BY pipeline, artifact) p
    ON n.pipeline = p.pipeline AND n.artifact = p.artifact
  WHERE p.src <> n.dst"""


def stages(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return turns.join(last, "conv_id").selectExpr(
        "concat('c', conv_id) AS pipeline", "turn AS ord", "concat('turn_', turn) AS stage",
        "CASE WHEN turn % 5 = 4 THEN '' ELSE role END AS cmd",
        "CASE WHEN turn > 0 THEN array(concat('c', conv_id, '/t', turn - 1)) "
        "WHEN conv_id % 10 = 0 THEN array(concat('c', conv_id, '/t', last)) ELSE CAST(array() AS ARRAY<STRING>) END AS deps",
        "array(concat('c', conv_id, '/t', turn)) AS outs")


def stage_files(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").filter("(conv_id + turn) % 7 <> 0").selectExpr(
        "concat('c', conv_id, '/t', turn) AS path", "FALSE AS is_dir",
        f"{minutes('(conv_id * 31 + turn * 17) % 100')} AS mtime")


# --- project trees: every customer is a project laid out by one template, with gaps

_ENTRIES = [(name, i, path, kind == "dirs") for name, parts in LAYOUTS.items()
            for i, (kind, path) in enumerate((k, p) for k in ("dirs", "files") for p in parts[k])]
_TEMPLATES = list(LAYOUTS)
VIEWS["vlayouts"] = "\n  SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {i}, '{p}', {str(d).upper()})" for t, i, p, d in _ENTRIES) + ") v(template, entry, path, is_dir)"
VIEWS["vprojects"] = f"""
  SELECT 'project_' || c_custkey AS project, {_sql_pick(_TEMPLATES, 'c_custkey % 7')} AS template, c_custkey FROM customer"""


def projects(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "concat('project_', c_custkey) AS project", f"{_pick(_TEMPLATES, 'c_custkey % 7')} AS template", "c_custkey")


def project_tree(spark, folder) -> DataFrame:
    entries = local_table(spark, _ENTRIES, "template string, entry int, path string, is_dir boolean")
    return (projects(spark, folder).join(entries, "template")
            .filter("(c_custkey + entry) % 5 <> 0").select("project", "path", "is_dir"))


# --- source texts: every part is a small Python file

SOURCE_TEXT = ("concat('import os, json\\nimport ', lower(p_type), '_lib.core as x\\nfrom ', replace(lower(p_brand), '#', '_'), "
               "' import y\\n\\ndef f_', p_partkey, '(a, b: int) -> str:\\n    \"\"\"', p_name, '\"\"\"\\n    return a\\n\\n"
               "async def g(): pass\\n\\nclass C:\\n    def m(self): pass\\n', CASE WHEN p_partkey % 11 = 0 THEN 'def (' ELSE '' END)")


def sources(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "part")).selectExpr("concat('src/p', p_partkey, '.py') AS path", f"{SOURCE_TEXT} AS content")


# --- pairs of neighbouring documents, notebooks made of document lines

VIEWS["vpairs"] = """
  SELECT a.doc_id AS key, a.text AS text_a, b.text AS text_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""
VIEWS["vlines"] = f"""
  SELECT path, ord AS line, text FROM (
    SELECT path, content, unnest(parts) AS text, generate_subscripts(parts, 1) AS ord, len(parts) AS n
    FROM (SELECT path, content, string_split_regex(content, {SQL_LINE_BREAK}) AS parts FROM vfiles))
  WHERE NOT (ord = n AND text = '')"""


def pairs(spark, folder) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    later = docs.select((F.col("doc_id") - 1).alias("key"), F.col("text").alias("text_b"))
    return docs.select(F.col("doc_id").alias("key"), F.col("text").alias("text_a")).join(later, "key").select(
        "key", F.concat(F.lit("doc_"), "key").alias("name_a"),
        F.concat(F.lit("doc_"), F.col("key") + 1).alias("name_b"), "text_a", "text_b")


def notebooks(spark, folder) -> DataFrame:
    """One notebook per document: a cell per line, every third one Markdown, every other code cell executed."""
    cells = F.transform(lines_of(F.col("content")), lambda line, i: F.struct(
        F.when(i % 3 == 0, "markdown").otherwise("code").alias("cell_type"),
        F.when(i % 2 == 1, i.cast("bigint")).alias("execution_count"), line.alias("source")))
    return spread(files(spark, folder)).select("path", F.to_json(F.struct(cells.alias("cells"))).alias("content"))


def with_ext(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.substring_index("path", "/", -1)).withColumn("ext", suffix(F.col("name")))


def sql(views: list[str], body: str) -> str:
    """A statement that starts from the named views; what they build on is added."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in VIEWS:
            if other != name and f" {other} " in VIEWS[name].replace("\n", " ").replace(")", " ) ") + " ":
                add(other)
        needed.append(name)

    for name in views:
        add(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return (f"WITH {head}\n" if head else "") + body.strip()
