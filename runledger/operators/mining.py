"""Facts mined from tables of source texts and archives, one small parse per row."""

from __future__ import annotations

import ast
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import STDLIB_MODULES


def _parse_imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, source in zip(batch["path"], batch["content"]):
            try:
                tree = ast.parse(source)
            except (SyntaxError, ValueError) as problem:
                rows.append((path, None, str(problem)))
                continue
            found = set()
            for node in ast.walk(tree):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else \
                    [node.module] if isinstance(node, ast.ImportFrom) and node.module else []
                found.update(name.partition(".")[0] for name in names)
            rows.extend((path, name, None) for name in sorted(found))
        yield pd.DataFrame(rows, columns=["path", "module", "error"])


def parse_imports(sources: DataFrame) -> DataFrame:
    """(path, module, error) of Python texts (path, content): top packages, or why a file fails."""
    return sources.select("path", "content").mapInPandas(_parse_imports, "path string, module string, error string")


def scan_imports(parsed: DataFrame) -> DataFrame:
    """(module) third-party imports; relative ones count by the name that follows the dots."""
    return parsed.filter(F.col("module").isNotNull() & ~F.col("module").isin(STDLIB_MODULES)).select("module").distinct()


def import_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("path", "error")


def requirements(modules: DataFrame, packages: DataFrame, pin_versions: bool = False) -> DataFrame:
    """(requirement) sorted without regard to case, from modules and a table (module, dist, version).

    A module without a known distribution stands for itself; with several, the first by
    name counts.
    """
    known = packages.groupBy("module").agg(F.min(F.struct("dist", "version")).alias("_first"))
    dist = F.coalesce("_first.dist", "module")
    text = F.when(F.col("_first.version").isNotNull(), F.concat_ws("==", dist, F.col("_first.version"))).otherwise(dist) \
        if pin_versions else dist
    return (modules.join(known, "module", "left").select(text.alias("requirement")).distinct()
            .orderBy(F.lower("requirement"), "requirement"))


def _parse_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, source in zip(batch["path"], batch["content"]):
            try:
                body = ast.parse(source).body
            except (SyntaxError, ValueError):
                continue
            for node in body:
                if isinstance(node, ast.FunctionDef):
                    returns = None if node.returns is None else ast.unparse(node.returns)
                    rows.append((path, node.name, [a.arg for a in node.args.args], returns, ast.get_docstring(node)))
        yield pd.DataFrame(rows, columns=["file", "function", "args", "returns", "doc"])


def api_index(sources: DataFrame) -> DataFrame:
    """(file, function, args, returns, doc) of top-level functions; unparsable files are passed over."""
    schema = "file string, function string, args array<string>, returns string, doc string"
    return sources.select("path", "content").mapInPandas(_parse_functions, schema)


def _escapes(name: str) -> bool:
    """Would this member land outside the folder it is unpacked into?"""
    landed = posixpath.normpath(posixpath.join("/inside/folder", name))
    return landed != "/inside/folder" and not landed.startswith("/inside/folder/")


def _parse_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            data = io.BytesIO(content)
            try:
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as handle:
                        kind, names = "zip", handle.namelist()
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data, mode="r:*") as handle:
                        kind, names = "tar", handle.getnames()
            except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                rows.append((path, None, None, None, None, "unsupported archive type"))
                continue
            rows.extend((path, kind, i, name, _escapes(name), None) for i, name in enumerate(names))
        yield pd.DataFrame(rows, columns=["archive", "archive_type", "position", "entry", "unsafe", "error"])


def archive_entries(archives: DataFrame) -> DataFrame:
    """(archive, archive_type, position, entry, unsafe, error) of zip and tar files (path, content)."""
    schema = "archive string, archive_type string, position int, entry string, unsafe boolean, error string"
    return archives.select("path", "content").mapInPandas(_parse_archives, schema)


def run_snapshot(snapshot_rows: DataFrame, run_ids: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the selected runs under one snapshot date, and a manifest row per run."""
    rows = snapshot_rows.join(run_ids.select("run_id").distinct(), "run_id", "left_semi").withColumn("snapshot", F.lit(stamp))
    size = F.octet_length("key") + F.octet_length("value")
    manifest = rows.groupBy("snapshot", "run_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(size.cast("bigint")).alias("byte_count"))
    return rows, manifest
