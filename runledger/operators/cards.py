"""Rendered documents as tables of lines.

Every document is a set of rows (doc, section, item, line), read in the order section, item.
Lines stay rows so that a document of any size is written by many tasks; use
:func:`write_documents` to get text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .quality import dataset_stats, sample_rows
from .runs import compare_runs, run_snapshot_rows, run_state, without_deleted

ORDER = ["section", "item"]


def _item(number: Column) -> Column:
    return F.format_string("%012d", number.cast("bigint"))


def _fixed(df: DataFrame, doc: Column, section: int, lines: list[Column | str]) -> DataFrame:
    """The same run of lines for every row of ``df``."""
    entries = [F.struct(F.lit(section).alias("section"), F.lit(f"{i:012d}").alias("item"),
                        (F.lit(line) if isinstance(line, str) else line).alias("line")) for i, line in enumerate(lines)]
    return df.select(doc.alias("doc"), F.inline(F.array(*entries)))


def _listed(df: DataFrame, doc: Column, section: int, item: Column, line: Column) -> DataFrame:
    return df.select(doc.alias("doc"), F.lit(section).alias("section"), item.alias("item"), line.alias("line"))


def _bullet(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("None")))


def model_card(info: DataFrame, tags: DataFrame, hints: DataFrame) -> DataFrame:
    """Card lines per model version: identity, tags, dataset hints."""
    doc = F.concat_ws("/", "name", "version")
    head = _fixed(info, doc, 0, ["# MODEL_CARD", "", _bullet("Name", F.col("name")), _bullet("Version", F.col("version")),
                                 _bullet("Stage", F.col("stage")), _bullet("Framework", F.col("framework")),
                                 _bullet("Path", F.col("path")), _bullet("Run ID", F.col("run_id")), "", "## Tags"])
    tag = _listed(tags, doc, 1, F.col("key"), F.concat(F.lit("- "), F.concat_ws(": ", "key", "value")))
    middle = _fixed(info, doc, 2, ["", "## Dataset Hints"])
    hint = _listed(hints.filter("dataset_hint IS NOT NULL"), doc, 3, F.col("dataset_hint"),
                   F.concat(F.lit("- "), "dataset_hint"))
    return head.unionByName(tag).unionByName(middle).unionByName(hint)


def described_model_card(models: DataFrame) -> DataFrame:
    """Card from given facts (model_name, task_type, dataset, metrics MAP, limitations ARRAY, usage_example)."""
    doc = F.col("model_name")
    head = _fixed(models, doc, 0, ["# MODEL_CARD", "", _bullet("Model", doc), _bullet("Task", F.col("task_type")),
                                   _bullet("Dataset", F.col("dataset")), "", "## Metrics"])

    def section(number: int, entries: Column, empty: str) -> DataFrame:
        filled = F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, entries).otherwise(F.array(F.lit(empty)))
        return models.select(doc.alias("doc"), F.posexplode(filled).alias("pos", "line")).select(
            "doc", F.lit(number).alias("section"), _item(F.col("pos")).alias("item"), "line")

    metrics = F.transform(F.map_entries("metrics"), lambda e: F.concat(
        F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("None"))))
    limits = F.transform("limitations", lambda x: F.concat(F.lit("- "), x))
    return (head.unionByName(section(1, metrics, "- N/A"))
            .unionByName(_fixed(models, doc, 2, ["", "## Limitations"]))
            .unionByName(section(3, limits, "- None provided"))
            .unionByName(_fixed(models, doc, 4, ["", "## Usage", F.col("usage_example")])))


def dataset_card(df: DataFrame, name: str, path: str, sample_key: list[str] | None = None, sample: int = 5,
                 description: str = "", license_name: str = "", intended_use: str = "") -> DataFrame:
    """Card lines of one dataset: identity, description, schema, null counts, first rows by key."""
    stats = cut_lineage(dataset_stats(df))
    doc = F.lit(name)
    one = stats.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"))
    head = _fixed(one, doc, 0, [
        "# DATASET_CARD", "", f"- Name: {name}", f"- Path: {path}", _bullet("Rows", F.col("rows")),
        _bullet("Columns", F.col("columns")), "", "## Description", description or "N/A", "", "## License",
        license_name or "N/A", "", "## Intended Use", intended_use or "N/A", "", "## Schema"])
    schema = _listed(stats, doc, 1, _item(F.col("position")), F.concat_ws(": ", F.concat(F.lit("- "), "column"), "dtype"))
    nulls = _listed(stats, doc, 3, _item(F.col("position")),
                    F.concat_ws(": ", F.concat(F.lit("- "), "column"), F.col("nulls").cast("string")))
    lines = (head.unionByName(schema).unionByName(_fixed(one, doc, 2, ["", "## Null Counts"])).unionByName(nulls))
    if sample_key:
        rows = sample_rows(df, sample_key, sample)
        key = F.concat_ws("/", *[_item(col(k)) if dict(df.dtypes)[k] in ("int", "bigint") else col(k).cast("string")
                                 for k in sample_key])
        lines = lines.unionByName(_fixed(one, doc, 4, ["", "## Sample Rows"])).unionByName(
            _listed(rows, doc, 5, key, F.to_json(F.struct(*[col(c) for c in df.columns]))))
    return lines


def experiment_report(run_events: DataFrame, params: DataFrame, metrics: DataFrame, project: str,
                      tombstones: DataFrame | None = None) -> DataFrame:
    """Report lines: every run, then how the two most recently updated ones differ."""
    run_events, params, metrics = (without_deleted(log, tombstones) for log in (run_events, params, metrics))
    state = cut_lineage(run_state(run_events))
    doc = F.lit(project)
    recent = state.orderBy(F.desc_nulls_last("updated_at"), "run_id").limit(2).collect()
    one = state.agg(F.count(F.lit(1)).alias("n"))
    lines = _fixed(one, doc, 0, ["# EXPERIMENT_REPORT", "", f"- Project: {project}", _bullet("Run Count", F.col("n")),
                                 "", "## Runs"])
    newest_first = F.format_string("%020d/%s", F.lit(10 ** 18) - F.coalesce(
        F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)), F.col("run_id").cast("string"))
    runs = _listed(state, doc, 1, newest_first, F.format_string(
        "- %s: status=%s, duration=%s", F.col("run_id").cast("string"), "status",
        F.coalesce(F.col("duration_seconds").cast("string"), F.lit("None"))))
    lines = lines.unionByName(runs).unionByName(_fixed(one, doc, 2, ["", "## Comparison"]))
    if len(recent) < 2:
        return lines.unionByName(_fixed(one, doc, 3, ["No comparison available"]))
    first, second = recent[0]["run_id"], recent[1]["run_id"]
    # the two runs' rows of each log, found before anything is folded
    pair = [log.filter(F.col("run_id").isin(first, second)) for log in (run_events, params, metrics)]
    diff = compare_runs(run_snapshot_rows(*pair), [first, second])
    changes = _listed(diff, doc, 3, F.col("key"), F.format_string(
        "- %s: %s -> %s", "key", F.coalesce("old", F.lit("None")), F.coalesce("new", F.lit("None"))))
    return lines.unionByName(changes).unionByName(_fixed(one, doc, 4, [
        "```mermaid", "graph TD", f"    run1[{first}] --> compare", f"    run2[{second}] --> compare", "```"]))


def project_readme(summary: DataFrame, imports: DataFrame, project: str) -> DataFrame:
    """Overview lines from :func:`directory_summary` and :func:`scan_imports`."""
    doc = F.lit(project)
    total = summary.filter("extension IS NULL")
    lines = _fixed(total, doc, 0, ["# Project Overview", "", f"- Project Path: {project}", _bullet("Files", F.col("file_count")),
                                   _bullet("Directories", F.col("directory_count")),
                                   _bullet("Total Size (bytes)", F.col("total_bytes")), "", "## Key Extensions"])
    per_ext = _listed(summary.filter("extension IS NOT NULL"), doc, 1, F.col("extension"),
                      F.concat_ws(": ", F.concat(F.lit("- "), "extension"), F.col("file_count").cast("string")))
    listed = _listed(imports, doc, 3, F.col("module"), F.concat(F.lit("- "), "module"))
    nothing = total if imports.isEmpty() else total.limit(0)
    return (lines.unionByName(per_ext).unionByName(_fixed(total, doc, 2, ["", "## Third-party Imports"]))
            .unionByName(listed).unionByName(_fixed(nothing, doc, 3, ["- None"])))


def api_docs(index: DataFrame, project: str) -> DataFrame:
    """API document lines from :func:`api_index`, by file and function."""
    doc = F.lit(project)
    args = F.concat(F.lit("["), F.concat_ws(", ", F.transform("args", lambda a: F.concat(F.lit("'"), a, F.lit("'")))), F.lit("]"))
    texts = [F.concat(F.lit("## "), "function"), _bullet("File", F.col("file")), F.concat(F.lit("- Args: "), args),
             _bullet("Returns", F.col("returns")),
             F.concat(F.lit("- Doc: "), F.when(F.col("doc") != "", F.col("doc")).otherwise("N/A"))]
    entries = [F.struct(F.lit(1).alias("section"), F.concat_ws("/", "file", "function", F.lit(str(i))).alias("item"),
                        text.alias("line")) for i, text in enumerate(texts)]
    body = index.select(doc.alias("doc"), F.inline(F.array(*entries)))
    one = index.sparkSession.range(1)
    return _fixed(one, doc, 0, ["# API Documentation", ""]).unionByName(body)


def render(df: DataFrame, template: str, out: str = "text") -> DataFrame:
    """Fill ``{{ name }}`` places of a template from the columns of each row."""
    text = F.lit(template)
    for name in df.columns:
        text = F.replace(text, F.lit("{{ " + name + " }}"), F.coalesce(col(name).cast("string"), F.lit("None")))
    return df.withColumn(out, text)


def write_documents(lines: DataFrame, path: str) -> DataFrame:
    """Write lines as text, one folder per document; returns (doc, bytes_written).

    Ranges of (doc, section, item) go to tasks, so part files in name order give the text.
    """
    (lines.repartitionByRange("doc", *ORDER).sortWithinPartitions("doc", *ORDER)
     .select("doc", F.col("line").alias("value")).write.mode("overwrite").partitionBy("doc").text(path))
    return lines.groupBy("doc").agg(F.sum(F.octet_length("line") + 1).alias("bytes_written"))
