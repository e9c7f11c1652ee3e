"""Retention plans: which files and runs would go, and why.  Nothing is deleted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from .ranks import newest


def retention_project(catalog: DataFrame, simulate: bool = True) -> DataFrame:
    """(path, is_dir, rule) of everything project cleaning removes.

    Ancestor names are read off the path itself, so the rules need no join.  With
    ``simulate`` directories that only become empty through the removal are listed as well.
    """
    parts = F.split("path", "/")
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in fv.REMOVABLE_DIRS]))
    named_file = ~F.col("is_dir") & (F.col("name").isin(fv.REMOVABLE_NAMES) | F.col("ext").isin(fv.REMOVABLE_SUFFIXES))
    rule = (F.when(F.col("is_dir") & F.col("name").isin(fv.REMOVABLE_DIRS), "directory").when(named_file, "file")
            .when(inside, "inside_directory"))
    judged = catalog.select("path", "is_dir", rule.alias("rule"))
    doomed = judged.filter("rule IS NOT NULL")
    survivors = (judged.filter("rule IS NULL AND NOT is_dir") if simulate else judged).select("path")
    # Every directory above a survivor, from its path alone.
    above = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                                 lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
                     lambda p: p != F.col("path"))
    alive = survivors.select(F.explode(above).alias("path")).distinct()
    empty = (judged.filter("is_dir AND rule IS NULL").join(alive, "path", "left_anti")
             .select("path", "is_dir", F.lit("empty_directory").alias("rule")))
    return doomed.unionByName(empty)


def retention_checkpoints(catalog: DataFrame, keep: int = 3, root: str = "root") -> DataFrame:
    """(root, path, mtime, action): the newest ``keep`` checkpoint files per root stay.

    Only the border, the oldest kept file of each root, is looked up (every input partition
    passes on at most ``keep`` rows); all other files compare themselves with it.
    """
    if keep < 0:
        raise ValueError("keep must be >= 0")
    files = catalog.filter(~F.col("is_dir") & F.col("ext").isin(fv.CHECKPOINT_EXTENSIONS)).select(root, "path", "mtime")
    order = [F.desc("mtime"), F.asc("path")]
    if keep == 0:
        return files.withColumn("action", F.lit("remove"))
    kept = newest(files, [root], order, keep)
    oldest = F.min("mtime").alias("_mtime")
    border = kept.groupBy(root).agg(oldest)
    last = (kept.join(border, root).filter(F.col("mtime") == F.col("_mtime"))
            .groupBy(root).agg(F.max("path").alias("_path"), F.first("_mtime").alias("_mtime"),
                               F.lit(True).alias("_any")))
    stays = (F.col("mtime") > F.col("_mtime")) | ((F.col("mtime") == F.col("_mtime")) & (F.col("path") <= F.col("_path")))
    return files.join(last, root, "left").select(
        root, "path", "mtime", F.when(stays, "keep").otherwise("remove").alias("action"))


def retention_runs(runs: DataFrame, metric_runs: DataFrame) -> DataFrame:
    """(run_id, action): kept only with status success and a metrics log (which may be empty)."""
    logged = metric_runs.select("run_id").distinct().withColumn("_logged", F.lit(True))
    keep = F.col("_logged").isNotNull() & F.coalesce(F.col("status") == "success", F.lit(False))
    return runs.select("run_id", "status").join(logged, "run_id", "left").select(
        "run_id", F.when(keep, "keep").otherwise("remove").alias("action"))


def retention_logs(catalog: DataFrame, min_size_bytes: int = 100) -> DataFrame:
    """(path, size, action) of ``*.log`` files: strictly smaller than the bound goes."""
    if min_size_bytes < 0:
        raise ValueError("min_size_bytes must be >= 0")
    logs = catalog.filter(~F.col("is_dir") & F.col("name").endswith(".log"))
    return logs.select("path", "size", F.when(F.col("size") < min_size_bytes, "remove").otherwise("keep").alias("action"))
