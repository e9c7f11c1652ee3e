"""File-catalog analytics.

A catalog is a table (path, name, ext, is_dir, size, mtime) with an optional ``content``
(text or bytes), as :mod:`runledger.sources.filetree` produces it.  ``path`` is relative to
the root and uses ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import artifact_type, category, framework, glob_to_regex, lines_of, suffix
from ..session import cut_lineage
from ..sources.filetree import content_digests, edge_digests

# Content types by suffix; anything else is application/octet-stream.
CONTENT_TYPES = {
    "text/csv": [".csv"], "text/tab-separated-values": [".tsv"], "application/json": [".json"],
    "text/plain": [".txt", ".log", ".ini"], "text/markdown": [".md"], "text/x-rst": [".rst"],
    "text/html": [".html", ".htm"], "text/x-python": [".py"], "application/x-sh": [".sh"],
    "image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"], "image/gif": [".gif"],
    "image/svg+xml": [".svg"], "image/webp": [".webp"], "application/zip": [".zip"],
    "application/x-tar": [".tar"], "application/yaml": [".yaml", ".yml"],
}


def _digest(catalog: DataFrame) -> Column:
    return F.col("md5") if "md5" in catalog.columns else F.md5("content")


def _sized(files: DataFrame, min_size: int | None, max_size: int | None) -> DataFrame:
    """Files within inclusive bounds; all files without bounds."""
    if min_size is not None:
        files = files.filter(F.col("size") >= min_size)
    return files if max_size is None else files.filter(F.col("size") <= max_size)


def files_only(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("is_dir"))


def list_files(catalog: DataFrame, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Paths (directories too) whose name fits the pattern, sorted; top level unless ``recursive``."""
    hits = catalog.filter(F.col("name").rlike(glob_to_regex(pattern)))
    if not recursive:
        hits = hits.filter(~F.col("path").contains("/"))
    return hits.select("path").orderBy("path")


def search_files(catalog: DataFrame, name_pattern: str = "*", extension: str | None = None,
                 min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Files by name pattern, suffix and inclusive size bounds: (path, size), sorted by path."""
    hits = files_only(catalog)
    if name_pattern != "*":
        hits = hits.filter(F.col("name").rlike(glob_to_regex(name_pattern)))
    if extension:
        hits = hits.filter(F.col("ext") == extension.lower())
    return _sized(hits, min_size, max_size).select("path", "size").orderBy("path")


def file_info(catalog: DataFrame) -> DataFrame:
    """Size, time, content type and MD5 of every file; a catalog may bring ``md5`` ready made instead of contents."""
    md5 = _digest(catalog)
    content_type = F.lit("application/octet-stream")
    for label, extensions in CONTENT_TYPES.items():
        content_type = F.when(F.col("ext").isin(extensions), label).otherwise(content_type)
    extra = [c for c in ("created_at", "permissions") if c in catalog.columns]
    return files_only(catalog).select(
        "path", "size", "mtime", *extra, content_type.alias("mime_type"),
        md5.alias("md5"), md5.isNull().alias("md5_skipped"))


def classify(catalog: DataFrame) -> DataFrame:
    """(path, extension, category) of every file."""
    return files_only(catalog).select("path", F.col("ext").alias("extension"), category(F.col("ext")).alias("category"))


def batch_classify(catalog: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classify the wanted paths; those that are no file come back with a reason."""
    known = catalog.select(F.col("path").alias("_path"), "is_dir", "ext")
    joined = paths.join(known, paths["path"] == known["_path"], "left")
    good = joined.filter("NOT is_dir").select(
        "path", F.col("ext").alias("extension"), category(F.col("ext")).alias("category"))
    bad = joined.filter("is_dir IS NULL OR is_dir").select("path", F.when(
        F.col("is_dir"), "path is not a file").otherwise("file not found").alias("error"))
    return good, bad


def detect_framework(catalog: DataFrame) -> DataFrame:
    """(path, extension, framework) of every file."""
    return files_only(catalog).select("path", F.col("ext").alias("extension"), framework(F.col("ext")).alias("framework"))


def with_artifact_type(df: DataFrame, path: str) -> DataFrame:
    """Add the lineage type of an artifact path."""
    return df.withColumn("type", artifact_type(suffix(F.substring_index(path, "/", -1))))


def find_dataset_files(catalog: DataFrame) -> DataFrame:
    """(path, size, modified_at) of the dataset files, sorted by path."""
    extensions = fv.CATEGORY_EXTENSIONS["dataset"]
    return (files_only(catalog).filter(F.col("ext").isin(extensions))
            .select("path", "size", F.col("mtime").alias("modified_at")).orderBy("path"))


def list_pipelines(catalog: DataFrame) -> DataFrame:
    """Paths of ``*.pipeline.yaml`` files, sorted."""
    return files_only(catalog).filter(F.col("name").endswith(".pipeline.yaml")).select("path").orderBy("path")


def discover_models(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source, model, detail): registered models, or the model files when none is registered."""
    registered = registry.select(F.lit("registry").alias("source"), F.col("name").alias("model"),
                                 F.col("current_stage").alias("detail"))
    if not registered.isEmpty():
        return registered.orderBy("model")
    found = files_only(catalog).filter(F.col("ext").isin(fv.MODEL_EXTENSIONS))
    return found.select(F.lit("filesystem").alias("source"), F.col("path").alias("model"),
                        F.col("ext").alias("detail")).distinct().orderBy("model")


def search_content(texts: DataFrame, query: str, file_pattern: str = "*", is_regex: bool = False,
                   case_sensitive: bool = False, max_matches: int | None = None) -> DataFrame:
    """Matching lines (path, line, text, truncated): all, or the first ``max_matches`` by path and line.

    ``truncated`` is set as soon as a limit is reached, also when nothing more follows.
    """
    source = texts if file_pattern == "*" else texts.filter(F.col("name").rlike(glob_to_regex(file_pattern)))

    def hit(text: Column) -> Column:
        if is_regex:
            return text.rlike(query if case_sensitive else f"(?iu){query}")
        return text.contains(query) if case_sensitive else F.lower(text).contains(query.lower())

    if not is_regex:     # a text without the words has no such line: skip the line split
        source = source.filter(hit(F.col("content")))
    lines = source.select("path", F.posexplode(lines_of(F.col("content"))).alias("line", "text"))
    matches = lines.filter(hit(F.col("text"))).withColumn("line", F.col("line") + 1).orderBy("path", "line")
    if max_matches is None:
        return matches.withColumn("truncated", F.lit(False))
    # Only the kept lines are counted: as many as the caller asked for.
    kept = Window.partitionBy(F.lit(0))
    return matches.limit(max_matches).withColumn("truncated", F.count(F.lit(1)).over(kept) >= max_matches)


def operation_history(audit: DataFrame, limit: int | None = 50) -> DataFrame:
    """The last ``limit`` operations, oldest first; all of them with ``limit=None``."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    last = audit if limit is None else audit.orderBy(F.desc("seq")).limit(limit)
    return last.orderBy("seq")


def directory_summary(catalog: DataFrame) -> DataFrame:
    """(extension, file_count, total_bytes) per suffix, and one total row with extension NULL.

    The total row also carries the number of directories.
    """
    ext = F.when(F.col("ext") == "", "<no_ext>").otherwise(F.col("ext"))
    tagged = catalog.select("is_dir", "size", F.when(~F.col("is_dir"), ext).alias("extension"))
    rolled = tagged.rollup("extension").agg(
        F.count_if(~F.col("is_dir")).alias("file_count"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("total_bytes"),
        F.count_if("is_dir").alias("directory_count"), F.grouping_id().alias("_level"))
    return (rolled.filter("extension IS NOT NULL OR _level = 1").drop("_level")
            .orderBy(F.asc_nulls_last("extension")))


def same_size_files(catalog: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Catalog rows, without content, whose size another file shares: the only ones worth reading.

    Feed them to :func:`runledger.sources.filetree.file_contents` when contents lie in storage.
    """
    sized = _sized(files_only(catalog).drop("content"), min_size, max_size)
    repeated = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    return sized.join(repeated, "size", "left_semi")


def duplicate_groups(catalog: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """(md5, n, size, first_path) of contents held more than once, largest group first.

    Contents become digests before the shuffle and copies are counted on the map side, so a
    content that fills a third of the catalog costs one row per task.
    """
    files = _sized(files_only(catalog), min_size, max_size)
    return (files.select(_digest(catalog).alias("md5"), "size", "path").groupBy("md5")
            .agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("path").alias("first_path"))
            .filter("n > 1").orderBy(F.desc("n"), "md5"))


def duplicate_cascade(catalog: DataFrame, root: str, min_size: int | None = None, max_size: int | None = None, edge: int = 4096) -> DataFrame:
    """Catalog rows with ``md5`` and ``bytes_read`` of the files below ``root`` that can have a copy.

    First sizes are compared, then the first and last ``edge`` bytes, and only files that still tie are read whole, in chunks.
    Most files cost nothing or a few kilobytes.  The result goes to :func:`duplicate_groups` or :func:`duplicate_members`.
    """
    sized = same_size_files(catalog, min_size, max_size)
    edges = cut_lineage(edge_digests(sized, root, edge).filter("edges IS NOT NULL"))
    tied = edges.groupBy("size", "edges").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    ties = edges.join(tied, ["size", "edges"], "left_semi")
    columns = [*sized.columns, "md5", "bytes_read"]
    whole = content_digests(ties.filter("md5 IS NULL").drop("md5"), root).withColumn("bytes_read", F.col("bytes_read") + F.col("size"))
    return ties.filter("md5 IS NOT NULL").select(columns).unionByName(whole.filter("md5 IS NOT NULL").select(columns))


def duplicate_members(catalog: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """(md5, path) of every file that has a copy: one row per member instead of lists.

    Contents are read and digested once, into a stored table of digests and paths.  The semi-join's large side is the one
    adaptive execution can split, so a digest with very many members is shared among tasks.
    """
    files = cut_lineage(_sized(files_only(catalog), min_size, max_size).select(_digest(catalog).alias("md5"), "path"))
    groups = files.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return files.join(groups, "md5", "left_semi")


def largest_files(catalog: DataFrame, top_k: int = 10) -> DataFrame:
    return files_only(catalog).select("path", "size").orderBy(F.desc("size"), "path").limit(top_k)


def storage_report(catalog: DataFrame, top_k: int = 10, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """One table of figures (section, item, count, bytes): totals, suffixes, largest files, savings.

    The catalog is read once, into a stored table without contents; ``min_size`` and ``max_size`` bound the copies counted as
    savings.
    """
    narrow = cut_lineage(catalog.select("path", "ext", "is_dir", "size", _digest(catalog).alias("md5")))
    ext = F.when(F.col("ext") == "", "<no_ext>").otherwise(F.col("ext"))
    figures = narrow.groupBy(F.when(~F.col("is_dir"), ext).alias("item"), "is_dir").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes"))
    by_ext = figures.filter("NOT is_dir").select(F.lit("extension").alias("section"), "item", "count", "bytes")
    totals = narrow.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"),
                        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes")).select(F.inline(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("files").alias("item"), F.col("files").alias("count"), "bytes"),
        F.struct(F.lit("total").alias("section"), F.lit("directories").alias("item"), F.col("directories").alias("count"),
                 F.lit(0).cast("bigint").alias("bytes")))))
    largest = largest_files(narrow, top_k).select(
        F.lit("largest").alias("section"), F.col("path").alias("item"),
        F.lit(1).cast("bigint").alias("count"), F.col("size").alias("bytes"))
    savings = duplicate_groups(narrow, min_size, max_size).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("bytes")).select(
        F.lit("duplicates").alias("section"), F.lit("groups").alias("item"), "count", "bytes")
    return totals.unionByName(by_ext).unionByName(largest).unionByName(savings)


def notebook_summary(notebooks: DataFrame) -> DataFrame:
    """(path, cell_count, code_cells, markdown_cells, last_execution_count) from notebook JSON texts.

    A notebook is one row, so its cells are counted in place: nothing is exploded or shuffled.
    """
    shape = "cells array<struct<cell_type: string, execution_count: bigint>>"
    cells = F.coalesce(F.col("_nb.cells"), F.array())
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    ran = F.filter(code, lambda c: c["execution_count"].isNotNull())
    return notebooks.select("path", F.from_json("content", shape).alias("_nb")).select(
        "path", F.size(cells).alias("cell_count"), F.size(code).alias("code_cells"),
        F.size(F.filter(cells, lambda c: c["cell_type"] == "markdown")).alias("markdown_cells"),
        F.try_element_at(ran, F.lit(-1))["execution_count"].alias("last_execution_count"))
