"""Stage graphs of many pipelines at once: stages (pipeline, ord, stage, cmd, deps, outs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graphs import cyclic

ID = ["pipeline", "stage"]


def stage_edges(stages: DataFrame) -> DataFrame:
    """(pipeline, src, dst): the last stage that lists an artifact as output feeds those that need it."""
    producers = (stages.select("pipeline", "ord", "stage", F.explode("outs").alias("artifact"))
                 .groupBy("pipeline", "artifact").agg(F.max_by("stage", "ord").alias("src")))
    needs = stages.select("pipeline", F.col("stage").alias("dst"), F.explode("deps").alias("artifact"))
    return needs.join(producers, ["pipeline", "artifact"]).filter("src <> dst").select("pipeline", "src", "dst").distinct()


def has_cycle(edges: DataFrame) -> DataFrame:
    """Pipelines whose graph has a cycle. All pipelines are judged together, graphs of any depth."""
    return cyclic(edges, ["pipeline"])


def validate_pipelines(stages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Errors (pipeline, stage, error, path); no row means valid.

    A dependency must exist in the catalog even when another stage produces it.
    """
    none = F.lit(None).cast("string")
    no_cmd = stages.filter("cmd IS NULL OR cmd = ''").select(*ID, F.lit("missing cmd").alias("error"), none.alias("path"))
    known = catalog.select("path").distinct()
    missing = (stages.select(*ID, F.explode("deps").alias("path")).join(known, "path", "left_anti")
               .select(*ID, F.lit("missing dependency").alias("error"), "path"))
    circular = has_cycle(stage_edges(stages)).select(
        "pipeline", none.alias("stage"), F.lit("circular dependency detected").alias("error"), none.alias("path"))
    return no_cmd.unionByName(missing).unionByName(circular)


def pipeline_status(stages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pipeline, stage, status, reason, missing_outputs, missing_count).

    Stale when an output is missing, or when the newest existing dependency is younger than
    the oldest output; otherwise up to date, also without dependencies or outputs.
    """
    def listed(column: str) -> DataFrame:
        return stages.select(*ID, F.explode(column).alias("path"), F.lit(column).alias("kind"))

    times = catalog.select("path", "mtime")
    joined = listed("deps").unionByName(listed("outs")).join(times, "path", "left")
    is_out = F.col("kind") == "outs"
    folded = joined.groupBy(*ID).agg(
        F.max(F.when(~is_out, F.col("mtime"))).alias("_dep"), F.min(F.when(is_out, F.col("mtime"))).alias("_out"),
        F.array_sort(F.collect_list(F.when(is_out & F.col("mtime").isNull(), F.col("path")))).alias("missing_outputs"))
    full = stages.select(*ID).join(folded, ID, "left")
    lacking = F.coalesce(F.size("missing_outputs"), F.lit(0))
    late = F.coalesce(F.col("_dep") > F.col("_out"), F.lit(False))
    return full.select(
        *ID, F.when((lacking > 0) | late, "stale").otherwise("up-to-date").alias("status"),
        F.when(lacking > 0, "missing_outputs").when(late, "deps_newer_than_outs").alias("reason"),
        F.when(lacking > 0, F.concat_ws(",", "missing_outputs")).alias("missing_outputs"),
        F.greatest(lacking, F.lit(0)).alias("missing_count"))


def add_stage(batch: DataFrame, stages: DataFrame) -> DataFrame:
    """New stages with a ``reason`` where the name is taken, in the table or earlier in the batch."""
    held = stages.select(*ID).distinct().withColumn("_held", F.lit(True))
    first = batch.groupBy(*ID).agg(F.min("ord").alias("_first"))
    taken = F.col("_held").isNotNull() | (F.col("ord") > F.col("_first"))
    return (batch.join(first, ID).join(held, ID, "left")
            .withColumn("reason", F.when(taken, "stage already exists")).drop("_held", "_first"))


def create_pipelines(stages: DataFrame) -> DataFrame:
    """The stages, provided there are any."""
    if stages.isEmpty():
        raise ValueError("stages must not be empty")
    return stages


def remove_stage(stages: DataFrame, removals: DataFrame) -> DataFrame:
    """(pipeline, removed, dependent): stages that need an output of a removed stage (not blocked).

    A removal without dependents, or of an unknown stage, has ``dependent`` NULL; ``found``
    tells the two apart.
    """
    gone = removals.select("pipeline", F.col("stage").alias("removed")).distinct()
    outs = stages.select("pipeline", F.col("stage").alias("removed"), F.lit(True).alias("found"),
                         F.explode_outer("outs").alias("artifact"))
    needs = stages.select("pipeline", F.col("stage").alias("dependent"), F.explode("deps").alias("artifact"))
    lost = gone.join(outs, ["pipeline", "removed"], "left")
    hit = lost.join(needs, ["pipeline", "artifact"], "left").select(
        "pipeline", "removed", F.coalesce("found", F.lit(False)).alias("found"),
        F.when(F.col("dependent") != F.col("removed"), F.col("dependent")).alias("dependent")).distinct()
    some = hit.filter("dependent IS NOT NULL").select("pipeline", "removed").distinct()
    return hit.filter("dependent IS NOT NULL").unionByName(
        hit.filter("dependent IS NULL").join(some, ["pipeline", "removed"], "left_anti"))


def without_stages(stages: DataFrame, removals: DataFrame) -> DataFrame:
    return stages.join(removals.select(*ID).distinct(), ID, "left_anti")


def pipeline_mermaid(stages: DataFrame) -> DataFrame:
    """Diagram lines (pipeline, section, ord, item, line): nodes as defined, then arrows by source order."""
    head = stages.select("pipeline").distinct().select(
        "pipeline", F.lit(0).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("item"), F.lit("graph TD").alias("line"))
    nodes = stages.select("pipeline", F.lit(1).alias("section"), "ord", F.col("stage").alias("item"),
                          F.format_string("    %s[%s]", "stage", "stage").alias("line"))
    order = stages.select("pipeline", F.col("stage").alias("src"), "ord")
    arrows = stage_edges(stages).join(order, ["pipeline", "src"]).select(
        "pipeline", F.lit(2).alias("section"), "ord", F.col("dst").alias("item"),
        F.format_string("    %s --> %s", "src", "dst").alias("line"))
    return head.unionByName(nodes).unionByName(arrows)


def pipeline_docs(stages: DataFrame) -> DataFrame:
    """Document lines (pipeline, section, ord, item, line): facts, stages, then the diagram."""
    def bracketed(name):
        return F.concat(F.lit("["), F.concat_ws(", ", F.transform(
            F.coalesce(F.col(name), F.array()), lambda x: F.concat(F.lit("'"), x, F.lit("'")))), F.lit("]"))

    counts = stages.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select("pipeline", F.inline(F.array(*[
        F.struct(F.lit(0).alias("section"), F.lit(i).alias("ord"), F.lit("").alias("item"), text.alias("line"))
        for i, text in enumerate([F.lit("# PIPELINE"), F.concat(F.lit("- Pipeline File: "), "pipeline"),
                                  F.concat(F.lit("- Stage Count: "), F.col("n").cast("string")), F.lit("## Stages")])])))
    body = stages.select("pipeline", F.lit(1).alias("section"), "ord", F.inline(F.array(
        F.struct(F.lit("0").alias("item"), F.concat(F.lit("### "), "stage").alias("line")),
        F.struct(F.lit("1").alias("item"), F.concat(F.lit("- cmd: "), F.coalesce("cmd", F.lit("None"))).alias("line")),
        F.struct(F.lit("2").alias("item"), F.concat(F.lit("- deps: "), bracketed("deps")).alias("line")),
        F.struct(F.lit("3").alias("item"), F.concat(F.lit("- outs: "), bracketed("outs")).alias("line")))))
    graph = counts.select("pipeline", F.lit(2).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("item"),
                          F.lit("## Graph").alias("line"))
    diagram = pipeline_mermaid(stages).withColumn("section", F.col("section") + 3)
    return head.unionByName(body).unionByName(graph).unionByName(diagram)
