"""Text lines, pipeline files, and state documents as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import lines_of
from ..session import cut_lineage

LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
STAGES = "pipeline string, ord int, stage string, cmd string, deps array<string>, outs array<string>, error string"


def text_lines(texts: DataFrame) -> DataFrame:
    """(path, line, text) with 1-based line numbers from (path, content)."""
    return texts.select("path", F.posexplode(lines_of(F.col("content"))).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text")


def _stage_rows(path: str, content: str) -> list[tuple]:
    try:
        payload = yaml.load(content, Loader=LOADER)
    except yaml.YAMLError as problem:
        return [(path, None, None, None, None, None, str(problem).splitlines()[0])]
    stages = payload.get("stages") if isinstance(payload, dict) else None
    rows = []
    for i, (name, spec) in enumerate(stages.items() if isinstance(stages, dict) else ()):
        if not isinstance(spec, dict):
            rows.append((path, i, str(name), None, [], [], "stage definition must be a mapping"))
            continue
        cmd = spec.get("cmd")
        rows.append((path, i, str(name), None if cmd is None else str(cmd), [str(d) for d in spec.get("deps") or []],
                     [str(o) for o in spec.get("outs") or []], None))
    return rows


def read_pipelines(texts: DataFrame) -> DataFrame:
    """Stage rows from pipeline texts (path, content), many files in one job; problems go to ``error``."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, text in zip(batch["path"], batch["content"]) for row in _stage_rows(path, text)]
            table = pd.DataFrame(rows, columns=["pipeline", "ord", "stage", "cmd", "deps", "outs", "error"])
            yield table.astype({"ord": "Int32"})

    return texts.select("path", "content").mapInPandas(parse, STAGES)


def read_run_documents(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Existing per-run JSON documents below ``root/<run_id>/`` as the append logs of ``operators.runs``."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.json$", 1).alias("run_id")

    def documents(name: str) -> DataFrame:
        return spark.read.text(f"{root}/*/{name}", wholetext=True).select(run, F.col("value").alias("doc"))

    params = documents("params.json").select("run_id", F.explode(F.from_json("doc", "map<string,string>")).alias("key", "value"))
    entries = documents("metrics.json").select(
        "run_id", F.posexplode(F.from_json("doc", "array<map<string,string>>")).alias("pos", "entry"))
    values = entries.select("run_id", F.col("pos").cast("bigint").alias("seq"),
                            F.expr("try_cast(entry['step'] AS BIGINT)").alias("step"),
                            F.expr("try_cast(entry['timestamp'] AS TIMESTAMP)").alias("ts"), F.explode("entry").alias("key", "text"))
    metrics = values.filter(~F.col("key").isin("step", "timestamp")).select(
        "run_id", "seq", "step", "ts", "key", F.expr("try_cast(text AS DOUBLE)").alias("value"))
    artifacts = documents("artifacts.json").select("run_id", F.posexplode(F.from_json(
        "doc", "array<struct<source: string, path: string, size: bigint, logged_at: timestamp>>")).alias("seq", "a")).select(
        "run_id", F.col("seq").cast("bigint").alias("seq"), "a.*")
    status = documents("status.json").select("run_id", F.from_json(
        "doc", "status string, started_at timestamp, ended_at timestamp").alias("s"))
    started = status.filter("s.started_at IS NOT NULL").select(
        "run_id", F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("event"), F.col("s.started_at").alias("ts"))
    ended = status.filter("s.status IN ('success', 'failed')").select(
        "run_id", F.lit(1).cast("bigint").alias("seq"), F.col("s.status").alias("event"), F.col("s.ended_at").alias("ts"))
    return {"run_events": started.unionByName(ended), "metrics": metrics, "artifacts": artifacts,
            "params": params.withColumn("seq", F.lit(0).cast("bigint")).select("run_id", "seq", "key", "value")}


def read_lineage_document(spark: SparkSession, path: str) -> DataFrame:
    """Lineage records from existing ``{"records": [...]}`` documents."""
    shape = "records array<struct<output: string, inputs: array<string>, run_id: string, timestamp: timestamp>>"
    docs = spark.read.schema(shape).json(path, multiLine=True)
    return docs.select(F.posexplode("records").alias("seq", "r")).select(
        F.col("seq").cast("bigint").alias("seq"), "r.output", "r.inputs", "r.run_id", F.col("r.timestamp").alias("ts"))


def append_log(df: DataFrame, path: str, bucket_by: str | None = None, buckets: int = 64) -> None:
    """Append rows to a parquet log; with ``bucket_by`` into hashed folders readers can prune."""
    if bucket_by is None:
        df.write.mode("append").parquet(path)
        return
    bucket = F.pmod(F.xxhash64(bucket_by), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, ids: list | None = None, key: str = "run_id", buckets: int = 64) -> DataFrame:
    """The log, or the rows of some ids: of a log written with ``bucket_by=key`` only their folders are listed and read."""
    log = spark.read.parquet(path)
    if ids is not None:
        kind = log.schema[key].dataType
        if "bucket" in log.columns:
            wanted = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias(key))
            found = wanted.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")).distinct().collect()
            log = log.filter(F.col("bucket").isin([r["bucket"] for r in found]))
        log = log.filter(F.col(key).isin(ids))
    return log.drop("bucket")


COMMITS = "_commits"


def _commit_place(spark: SparkSession, path: str, batch: str | None = None):
    """Hadoop file system and place of a log's commit folder, or of one batch's mark in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}" + (f"/{batch}" if batch else ""))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Append a named batch to a log exactly once; False if the log has it already.

    A batch is a folder of its own, and readers see it only once its mark stands in the commit folder.  Whoever repeats a batch, after a
    failure anywhere or although it had succeeded, replaces what was not committed and never doubles what was.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
        raise ValueError("batch must be letters, digits, dots and dashes")
    files, mark = _commit_place(df.sparkSession, path, batch)
    if files.exists(mark):
        return False
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    files.create(mark, True).close()
    return True


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of a log's committed batches."""
    files, place = _commit_place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches of a log written with :func:`append_once`, with their ``batch``."""
    batches = committed(spark, path)
    if not batches:
        raise ValueError(f"no committed batch in {path}")
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/batch={b}" for b in batches])
    return rows.withColumn("batch", F.col("batch").cast("string"))


def compact(spark: SparkSession, path: str, batch: str) -> None:
    """Put all committed batches together as one named ``batch`` and drop their folders; a repeated call ends what one had begun."""
    old = [b for b in committed(spark, path) if b != batch]
    files, mark = _commit_place(spark, path, batch)
    if not files.exists(mark):
        rows = read_committed(spark, path).drop("batch")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        # what the new batch replaces is named in its mark, so a call that ends between the two steps can be repeated
        stream = files.create(mark, True)
        stream.writeBytes("\n".join(old))
        stream.close()
    for name in _replaced(spark, path, batch):
        files.delete(_commit_place(spark, path, name)[1], True)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={name}"), True)


def _replaced(spark: SparkSession, path: str, batch: str) -> list[str]:
    text = spark.read.text(f"{path}/{COMMITS}/{batch}", wholetext=True).collect()
    return [n for r in text for n in r["value"].split("\n") if n]


def variant_documents(texts: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``doc``, the JSON text as VARIANT with every field it has, and ``error`` where it is no JSON."""
    doc = F.try_parse_json(F.col(content))
    return texts.withColumn("doc", doc).withColumn("error", F.when(F.col(content).isNotNull() & F.col("doc").isNull(), "not a JSON document")).drop(content)


def variant_fields(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, type, text, number, flag): one row for each innermost value of ``doc``, whatever its fields are called.

    ``type`` is string, number, boolean or null, or object and array where these are empty.  Nesting is opened level by level, all
    documents together; rounds are stored.
    """
    spark, found = documents.sparkSession, None
    level = documents.filter("doc IS NOT NULL").select(*keys, F.lit("$").alias("path"), F.col("doc").alias("v"))
    named = ", ".join(f"`{k}`" for k in keys)
    while True:
        kind = F.schema_of_variant("v")
        level = cut_lineage(level.withColumn("_object", kind.startswith("OBJECT")).withColumn("_array", kind.startswith("ARRAY"))
                            .withColumn("_empty", F.to_json("v").isin("{}", "[]")))
        inner = "(_object OR _array) AND NOT _empty"
        leaves = level.filter(f"NOT ({inner})")
        found = leaves if found is None else found.unionByName(leaves)
        deeper = level.filter(inner)
        if deeper.isEmpty():
            break
        level = spark.sql(f"""SELECT {named}, concat(path, CASE WHEN _array THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v
                              FROM {{deeper}}, LATERAL variant_explode(v) e""", deeper=deeper)
    kind = F.schema_of_variant("v")
    nature = (F.when(F.col("_object"), "object").when(F.col("_array"), "array").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean")
              .when(kind == "STRING", "string").otherwise("number"))
    return found.select(*keys, "path", nature.alias("type"), F.when(nature == "string", F.try_variant_get("v", "$", "string")).alias("text"),
                        F.when(nature == "number", F.try_variant_get("v", "$", "double")).alias("number"),
                        F.when(nature == "boolean", F.try_variant_get("v", "$", "boolean")).alias("flag"))


def write_pipelines(stages: DataFrame, path: str) -> None:
    """A parquet table of texts (path, content): each pipeline's stages as a map in flow style, which YAML reads.

    Texts are rows, as they are for :func:`read_pipelines`: a folder of one small file per pipeline would not scale.  A
    pipeline's stages are put together in one row; they are as many as someone wrote by hand.
    """
    fields = F.struct("ord", "stage", "cmd", "deps", "outs")
    listed = stages.groupBy("pipeline").agg(F.sort_array(F.collect_list(fields)).alias("s"))
    entry = F.transform("s", lambda x: F.concat(
        F.regexp_extract(F.to_json(F.array(x["stage"])), r"(?s)^\[(.*)\]$", 1), F.lit(": "),
        F.to_json(F.struct(x["cmd"].alias("cmd"), x["deps"].alias("deps"), x["outs"].alias("outs")))))
    content = F.concat(F.lit('{"stages": {'), F.array_join(entry, ", "), F.lit("}}"))
    listed.select(F.concat("pipeline", F.lit(".pipeline.yaml")).alias("path"), content.alias("content")).write.mode("overwrite").parquet(path)


def read_registry_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Existing ``{"models": {name: [entry, ...]}}`` documents as the logs of ``operators.registry``."""
    entry = ("name string, version bigint, stage string, run_id string, path string, size bigint, framework string, "
             "registered_at timestamp, tags map<string,string>, deprecation_reason string, "
             "stage_history array<struct<stage: string, timestamp: timestamp>>")
    docs = spark.read.text(path, wholetext=True)
    models = F.from_json("value", f"models map<string, array<struct<{_struct_fields(entry)}>>>")["models"]
    listed = docs.select(F.explode(models).alias("model", "entries")).select(F.explode("entries").alias("e")).select("e.*")
    versions = listed.select("name", "version", "run_id", "path", "size", "framework", "registered_at", F.col("version").alias("seq"))
    steps = listed.select("name", "version", "deprecation_reason", F.posexplode("stage_history").alias("pos", "h"))
    stages = steps.select("name", "version", F.col("pos").cast("bigint").alias("seq"), "h.stage", F.col("h.timestamp").alias("ts"),
                          F.when(F.col("h.stage") == "deprecated", F.col("deprecation_reason")).alias("reason"))
    tags = listed.select("name", "version", F.lit(0).cast("bigint").alias("seq"), F.explode("tags").alias("key", "value"))
    return {"model_versions": versions, "stage_events": stages, "tag_log": tags}


def _struct_fields(ddl: str) -> str:
    """Top-level DDL fields (name type) in the form a nested struct wants (name: type)."""
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]
