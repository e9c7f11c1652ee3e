"""Joins and differences: trees, texts, requirements, layouts, required keys."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import lines_of, strip
from ..functions.fixed_values import LAYOUTS
from ..session import local_table


def tree_diff(a: DataFrame, b: DataFrame, key: str = "path", digest: Column | None = None) -> DataFrame:
    """(path, state) of everything that differs: only_in_a, only_in_b or different_content.

    Contents are reduced to a digest before the join, so only (path, digest) is shuffled.
    """
    digest = F.md5("content") if digest is None else digest
    left = a.select(F.col(key).alias("path"), digest.alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(F.col(key).alias("path"), digest.alias("_b"), F.lit(True).alias("_in_b"))
    state = (F.when(F.col("_in_b").isNull(), "only_in_a").when(F.col("_in_a").isNull(), "only_in_b")
             .when(~F.col("_a").eqNullSafe(F.col("_b")), "different_content"))
    return (left.join(right, "path", "full_outer").select("path", state.alias("state"))
            .filter(F.col("state").isNotNull()))


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, name_a, name_b, text_a, text_b in zip(
                batch["key"], batch["name_a"], batch["name_b"], batch["text_a"], batch["text_b"]):
            lines = list(difflib.unified_diff(text_a.splitlines(), text_b.splitlines(), name_a, name_b, lineterm=""))
            added = sum(1 for x in lines if x.startswith("+") and not x.startswith("+++"))
            removed = sum(1 for x in lines if x.startswith("-") and not x.startswith("---"))
            rows.append((key, not lines, added, removed, lines))
        yield pd.DataFrame(rows, columns=["key", "identical", "added", "removed", "diff_lines"])


def text_diff(pairs: DataFrame) -> DataFrame:
    """Unified diff per pair (key, name_a, name_b, text_a, text_b); one pair never leaves its row.

    Equal texts are settled in the JVM.  A changed line that itself starts with ``++`` or
    ``--`` is listed but not counted.
    """
    same = pairs.filter(F.col("text_a") == F.col("text_b")).select(
        F.col("key").cast("string").alias("key"), F.lit(True).alias("identical"), F.lit(0).cast("bigint").alias("added"),
        F.lit(0).cast("bigint").alias("removed"), F.array().cast("array<string>").alias("diff_lines"))
    changed = pairs.filter(F.col("text_a") != F.col("text_b")).select(
        F.col("key").cast("string").alias("key"), "name_a", "name_b", "text_a", "text_b")
    schema = "key string, identical boolean, added bigint, removed bigint, diff_lines array<string>"
    return same.unionByName(changed.mapInPandas(_unified, schema))


def line_delta(pairs: DataFrame) -> DataFrame:
    """Lines added and removed per pair as multisets: (key, text, added, removed).

    Does not look at line order, so it needs no per-pair algorithm: one aggregation by
    (key, line) with counts combined on the map side.
    """
    def side(text: str, sign: int) -> DataFrame:
        return pairs.select("key", F.explode(lines_of(F.col(text))).alias("text"), F.lit(sign).alias("d"))

    net = (side("text_a", -1).unionAll(side("text_b", 1)).groupBy("key", "text")
           .agg(F.sum("d").alias("net")).filter("net <> 0"))
    return net.select("key", "text", F.greatest(F.col("net"), F.lit(0)).alias("added"),
                      F.greatest(-F.col("net"), F.lit(0)).alias("removed"))


def line_delta_counts(pairs: DataFrame) -> DataFrame:
    """(key, added, removed) of the pairs whose lines differ."""
    return line_delta(pairs).groupBy("key").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def parse_requirements(files: DataFrame) -> DataFrame:
    """(file, package, version) from requirement texts (file, content); the last entry of a name wins."""
    lines = files.select("file", F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    lines = (lines.withColumn("line", strip(F.col("line")))
             .filter((F.col("line") != "") & ~F.col("line").startswith("#")))
    pinned = F.col("line").contains("==")
    name = strip(F.substring_index("line", "==", 1))
    version = F.when(pinned, strip(F.expr("substring(line, locate('==', line) + 2)")))
    parsed = lines.select("file", F.lower(name).alias("package"), F.struct("pos", version.alias("version")).alias("last"))
    return (parsed.groupBy("file", "package").agg(F.max("last").alias("last"))
            .select("file", "package", F.col("last.version").alias("version")))


def compare_requirements(base: DataFrame, target: DataFrame) -> DataFrame:
    """(package, change, from, to) between two parsed requirement tables (package, version)."""
    left = base.select("package", F.col("version").alias("from"), F.lit(True).alias("_in_base"))
    right = target.select("package", F.col("version").alias("to"), F.lit(True).alias("_in_target"))
    change = (F.when(F.col("_in_base").isNull(), "added").when(F.col("_in_target").isNull(), "removed")
              .when(~F.col("from").eqNullSafe(F.col("to")), "version_changed"))
    return (left.join(right, "package", "full_outer").select("package", change.alias("change"), "from", "to")
            .filter(F.col("change").isNotNull()))


def layout_table(spark) -> DataFrame:
    """(template, path, is_dir) of every known project layout."""
    rows = [(name, path, kind == "dirs") for name, parts in LAYOUTS.items() for kind in ("dirs", "files")
            for path in parts[kind]]
    return local_table(spark, rows, "template string, path string, is_dir boolean")


def layout_check(catalog: DataFrame, projects: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Missing entries (project, template, path, is_dir) of many projects at once.

    ``projects`` holds (project, template), ``catalog`` (project, path, is_dir).  An unknown
    template is an error; no row for a project means it is complete.
    """
    layouts = layout_table(catalog.sparkSession) if layouts is None else layouts
    unknown = projects.join(layouts.select("template").distinct(), "template", "left_anti")
    first = unknown.first()
    if first:
        raise ValueError(f"unknown template '{first['template']}'")
    expected = projects.join(layouts, "template")
    return (expected.join(catalog.select("project", "path", "is_dir"), ["project", "path", "is_dir"], "left_anti")
            .select("project", "template", "path", "is_dir"))


def parse_keys(files: DataFrame) -> DataFrame:
    """(file, key, value) from ``KEY=value`` texts; comments and blank lines are skipped."""
    lines = files.select("file", F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    lines = (lines.withColumn("line", strip(F.col("line")))
             .filter((F.col("line") != "") & ~F.col("line").startswith("#")))
    key = strip(F.substring_index("line", "=", 1))
    value = F.when(F.col("line").contains("="),
                   strip(F.expr("substring(line, locate('=', line) + 1)")))
    return lines.select("file", "pos", key.alias("key"), value.alias("value")).filter(F.col("key") != "")


def required_keys(required: DataFrame, provided: DataFrame) -> DataFrame:
    """Required keys (scope, key) that no source provides, or provides empty.

    ``provided`` holds (scope, key, priority, value).  The source with the lowest priority
    number wins, also when its value is empty.
    """
    winner = (provided.filter("value IS NOT NULL").groupBy("scope", "key")
              .agg(F.min_by("value", "priority").alias("value")).filter("value <> ''"))
    return required.select("scope", "key").join(winner, ["scope", "key"], "left_anti")
