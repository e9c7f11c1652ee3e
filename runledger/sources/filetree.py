"""Catalog of a shared file tree as a Spark data source, hidden names and folders included; contents and digests of its files.

A walk takes bounds of its own (a folder, a name pattern, sizes): folders that nothing wanted can lie below are never opened, and names
are judged before anything is asked about a file.  They are arguments, not filters that Spark pushes down: Spark keeps one reader for all
uses of a table from a Python source, so filters pushed by one use would also hold for the others.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.columns import suffix

SCHEMA = "path string, name string, is_dir boolean, size bigint, mtime timestamp, created_at timestamp, permissions string"


class Folders(InputPartition):
    """The folders one task lists: (path, with everything below it or on its own)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root (plain path, file:, s3:, gs:, hdfs: ...) and the path in it."""
    if "://" in root or root.startswith("file:"):
        scheme, _, rest = root.partition(":")
        root = f"{scheme}://{'/' + rest.lstrip('/') if scheme == 'file' else rest[2:]}"
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.realpath(root)


def _children(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, recursive=False))


def _utc(seconds: float | None) -> datetime | None:
    return None if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)


class Wanted:
    """The bounds of a walk, from the source's options."""

    def __init__(self, options: dict):
        self.folder = options.get("below", "").strip("/")
        self.name = fnmatch.translate(options["pattern"]) if "pattern" in options else None
        self.least, self.most = (int(options[k]) if k in options else None for k in ("min_size", "max_size"))

    def inside(self, path: str) -> bool:
        return not self.folder or path.startswith(f"{self.folder}/")

    def named(self, name: str) -> bool:
        return self.name is None or re.fullmatch(self.name, name) is not None

    def sized(self, is_dir: bool, size: int | None) -> bool:
        """Bounds of size hold for files; with one, folders are not listed."""
        if self.least is None and self.most is None:
            return True
        return not is_dir and size is not None and (self.least or 0) <= size and (self.most is None or size <= self.most)

    def open(self, folder: str) -> bool:
        """Whether something wanted can lie below a folder (its path from the root)."""
        return not self.folder or f"{self.folder}/".startswith(f"{folder}/") or f"{folder}/".startswith(f"{self.folder}/")


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.tasks = int(options.get("partitions", "64"))
        self.wanted = Wanted(options)

    def partitions(self):
        """Open the shallowest folders until a few per task can be dealt out; only those are listed here."""
        system, base = open_root(self.root)
        if system.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"directory not found: {self.root}")
        opened, waiting = [], [base]
        while waiting and len(waiting) < 4 * self.tasks:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting.extend(e.path for e in _children(system, folder) if _is_folder(system, e) and self.wanted.open(os.path.relpath(e.path, base)))
        shares = [(f, False) for f in opened] + [(f, True) for f in waiting]
        return [Folders(shares[i::self.tasks]) for i in range(min(self.tasks, len(shares)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, base = open_root(self.root)
        local, wanted = isinstance(system, fs.LocalFileSystem), self.wanted
        stack = list(partition.folders)
        while stack:
            folder, deep = stack.pop()
            for entry in _children(system, folder):
                if entry.type not in (fs.FileType.File, fs.FileType.Directory):
                    continue             # a dangling link: neither file nor folder
                is_dir, path = entry.type == fs.FileType.Directory, os.path.relpath(entry.path, base)
                if deep and _is_folder(system, entry) and wanted.open(path):
                    stack.append((entry.path, True))
                if not (wanted.inside(path) and wanted.named(entry.base_name)):
                    continue
                created, mode = None, None
                if local:
                    stat = os.stat(entry.path)
                    created, mode = stat.st_ctime, oct(stat.st_mode & 0o777)
                size = stat.st_size if local else entry.size
                if not wanted.sized(is_dir, size):
                    continue
                mtime = stat.st_mtime if local else entry.mtime_ns and entry.mtime_ns / 1e9
                yield (path, entry.base_name, is_dir, size, _utc(mtime), _utc(created), mode)


def _is_folder(system: fs.FileSystem, entry: fs.FileInfo) -> bool:
    """A real folder to walk into; links to folders are listed but not followed."""
    if entry.type != fs.FileType.Directory:
        return False
    return not (isinstance(system, fs.LocalFileSystem) and os.path.islink(entry.path))


class FileTreeSource(DataSource):
    """``spark.read.format("filetree").option("partitions", 64).load(root)``"""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return FileTreeReader(self.options)


def file_catalog(spark: SparkSession, root: str, partitions: int | None = None, below: str | None = None, pattern: str | None = None,
                 min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """(path, name, ext, is_dir, size, mtime, created_at, permissions) of everything below ``root``.

    ``root`` is a folder every executor sees: a shared mount, or a URI that Arrow can open.  ``below`` (a folder in it), ``pattern`` (of
    names) and inclusive sizes (of files; folders are then left out) bound the walk itself.
    """
    spark.dataSource.register(FileTreeSource)
    partitions = partitions or 2 * spark.sparkContext.defaultParallelism
    reader = spark.read.format("filetree").option("partitions", partitions)
    for name, value in (("below", below), ("pattern", pattern), ("min_size", min_size), ("max_size", max_size)):
        if value is not None:
            reader = reader.option(name, value)
    listed = reader.load(root)
    ext = F.when(F.col("is_dir"), "").otherwise(suffix(F.col("name")))
    return listed.select("path", "name", ext.alias("ext"), "is_dir", "size", "mtime", "created_at", "permissions")


def stored_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog through Spark's own listing, for stores Arrow cannot open: no folders, no names starting with . or _."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit(""))
    name = F.substring_index("path", "/", -1)
    return files.select(path.alias("path"), name.alias("name"), suffix(name).alias("ext"), F.lit(False).alias("is_dir"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _dealt(files: DataFrame, *by: str) -> DataFrame:
    """Names dealt to as many tasks as shuffles have.  The number is given: adaptive execution would put the few bytes of the names, and so
    the reading of all files, into one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _in_shares(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of files that hold at most ``most`` bytes together, or one file."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if sizes:
        yield first, len(sizes)


def file_contents(catalog: DataFrame, root: str, min_size: int = 0, max_size: int | None = None, most: int = 4 << 20) -> DataFrame:
    """Add ``content`` bytes to the files of a catalog within the size bounds.

    Paths are spread over tasks first: one folder that holds most files does not keep one task reading.  Batches hold at most ``most``
    bytes, or one file; :func:`file_pieces` reads files that are too big to be one value.  Files that cannot be read get NULL.
    """
    files = catalog.filter(~F.col("is_dir") & (F.col("size") >= min_size))
    if max_size is not None:
        files = files.filter(F.col("size") <= max_size)
    schema = StructType([*files.schema.fields]).add("content", "binary")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)

        def read(path: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/{path}", compression=None) as handle:
                    return handle.read()
            except OSError:
                return None

        for batch in batches:
            for first, end in _in_shares(batch.column("size").to_pylist(), most):
                part = batch.slice(first, end - first)
                contents = pa.array([read(path) for path in part.column("path").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, contents], [*part.schema.names, "content"])

    return _dealt(files, "path").mapInArrow(load, schema)


def _to_character(data: bytes) -> int:
    """How many of the first three bytes only continue a UTF-8 character."""
    return next((k for k, byte in enumerate(data[:3]) if byte & 0xC0 != 0x80), min(len(data), 3))


def file_pieces(catalog: DataFrame, root: str, piece: int = 4 << 20) -> DataFrame:
    """The files of a catalog in pieces of about ``piece`` bytes: adds ``start`` and ``content``.

    A piece is a row of its own before it is read, so a file of any size is shared among tasks and takes a piece's memory.  Pieces end
    between UTF-8 characters.  Files that cannot be read get NULL.
    """
    last = F.greatest(F.col("size") - 1, F.lit(0))
    files = catalog.filter(~F.col("is_dir")).withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(piece).cast("bigint"))))
    schema = StructType([*files.schema.fields]).add("content", "binary")

    def read(system: fs.FileSystem, path: str, start: int) -> tuple[int, bytes | None]:
        try:
            with system.open_input_file(path) as handle:
                size = handle.size()
                data = handle.read_at(min(piece + 3, max(size - start, 0)), start)
        except OSError:
            return start, None
        skipped = _to_character(data) if start else 0
        return start + skipped, data[skipped:piece + _to_character(data[piece:])]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        for batch in batches:
            for k, (path, start) in enumerate(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist())):
                begin, content = read(system, f"{base}/{path}", start)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:-1], pa.array([begin]), pa.array([content], pa.binary())],
                                                 [*batch.schema.names, "content"])

    return _dealt(files, "path", "start").mapInArrow(load, schema)


def text_sizes(pieces: DataFrame) -> DataFrame:
    """(path, bytes) of the files in :func:`file_pieces` that are valid UTF-8 throughout."""
    valid = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    return (pieces.groupBy("path").agg(F.bool_and(valid).alias("valid"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))
            .filter("valid").drop("valid"))


def _walk_rows(files: DataFrame, added: list[tuple[str, pa.DataType]], work: Callable[[fs.FileSystem, str, int | None], tuple]) -> Callable:
    """For each file of a catalog, its columns and what ``work`` (file system, path, size) gives for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(path, size) for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist())]
            columns = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(name for name, _ in added)])
    return run


def stream_md5(handle, chunk: int = 1 << 20) -> str:
    """MD5 of an open stream, a chunk at a time."""
    digest = hashlib.md5(usedforsecurity=False)
    while part := handle.read(chunk):
        digest.update(part)
    return digest.hexdigest()


def content_digests(catalog: DataFrame, root: str, chunk: int = 1 << 20) -> DataFrame:
    """The files of a catalog with ``md5``, read in chunks: files of any size, and no content ever becomes a value.

    Files that can't be read get NULL.  ``operators.catalog.file_info`` and the rest take such a catalog instead of contents.
    """
    files = catalog.filter(~F.col("is_dir"))

    def digest(path: str, size: int | None) -> tuple:
        system, base = open_root(root)
        try:
            with system.open_input_stream(f"{base}/{path}", compression=None) as handle:
                return (stream_md5(handle, chunk),)
        except OSError:
            return (None,)

    schema = StructType([*files.schema.fields]).add("md5", "string")
    return _dealt(files, "path").mapInArrow(_walk_rows(files, [("md5", pa.string())], digest), schema)


def edge_digests(files: DataFrame, root: str, edge: int = 4096) -> DataFrame:
    """Adds ``edges`` (MD5 of a file's first and last ``edge`` bytes), ``md5`` where these are all its bytes, and ``bytes_read``."""
    def digest(path: str, size: int | None) -> tuple:
        system, base = open_root(root)
        try:
            with system.open_input_file(f"{base}/{path}") as handle:
                length = handle.size()
                content = handle.read_at(min(length, 2 * edge), 0) if length <= 2 * edge else handle.read_at(edge, 0) + handle.read_at(edge, length - edge)
        except OSError:
            return (None, None, 0)
        found = hashlib.md5(content, usedforsecurity=False).hexdigest()
        return (found, found if length <= 2 * edge else None, len(content))

    schema = StructType([*files.schema.fields]).add("edges", "string").add("md5", "string").add("bytes_read", "long")
    added = [("edges", pa.string()), ("md5", pa.string()), ("bytes_read", pa.int64())]
    return _dealt(files, "path").mapInArrow(_walk_rows(files, added, digest), schema)


def write_files(texts: DataFrame, root: str) -> None:
    """Write rows (path, content) as files below ``root``, a folder all executors share. Writing a row again gives the same file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = os.path.dirname(f"{base}/{path}")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as handle:
                    handle.write(content)
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    rows = texts.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def text_contents(files: DataFrame) -> DataFrame:
    """Decode ``content``; files that are no valid UTF-8 are dropped."""
    return files.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string"))
