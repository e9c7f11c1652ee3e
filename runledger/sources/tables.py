"""Reading and writing tables by file extension."""

from __future__ import annotations

import fnmatch
import json
import operator
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import yaml
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .filetree import open_root

ROW_TESTS: dict[str, Callable] = {"==": pc.equal, "!=": pc.not_equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal,
                                  "in": lambda column, values: pc.is_in(column, pa.array(values, column.type))}
OPERATORS = {"==": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
READABLE = [".csv", ".tsv", ".json", ".jsonl", ".parquet", ".feather"]


def extension(path: str) -> str:
    return posixpath.splitext(path.rstrip("/"))[1].lower()


def read_table(spark: SparkSession, path: str | list[str], schema=None, quoted_breaks: bool = False, columns: list[str] | None = None,
               where: list[tuple] | None = None, share: int = 16 << 20) -> DataFrame:
    """A table from .csv, .tsv, .json, .jsonl, .parquet or .feather files (globs and lists work).

    Give ``schema`` for big text inputs: without it Spark reads them once more to infer types.
    ``quoted_breaks`` allows line ends inside quoted CSV fields; such files are not split.  ``columns`` reads only these, ``where`` only rows
    that fit all of (column, operator, value) with operators == != > >= < <= in.  Feather files are split into shares of about ``share``
    bytes at their record batches, and judge both themselves.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {extension(p) for p in paths}
    if len(kinds) != 1 or not kinds <= set(READABLE):
        raise ValueError(f"can't read dataset type: {', '.join(sorted(kinds))}")
    kind = kinds.pop()
    if kind == ".feather":
        return _read_feather(spark, paths, schema, columns, where or [], share)
    table = _read_text_or_parquet(spark, paths, kind, schema, quoted_breaks)
    for name, test, value in where or []:
        table = table.filter(F.col(name).isin(value) if test == "in" else getattr(operator, OPERATORS[test])(F.col(name), value))
    return table if columns is None else table.select(columns)


def _read_text_or_parquet(spark: SparkSession, paths: list[str], kind: str, schema, quoted_breaks: bool) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in (".csv", ".tsv"):
        return reader.csv(paths, header=True, inferSchema=schema is None, sep="\t" if kind == ".tsv" else ",",
                          quote='"', escape='"', multiLine=quoted_breaks)
    if kind == ".json" and schema is None:
        found = _json_schema(spark, paths)
        reader = reader if found is None else reader.schema(found)
    if kind in (".json", ".jsonl"):
        return reader.json(paths, multiLine=kind == ".json")
    return reader.parquet(*paths)


def _json_schema(spark: SparkSession, paths: list[str]) -> StructType | None:
    """The schema of files that each hold one JSON text, or None where Spark's reader must tell.

    That reader packs files for this by their bytes alone: very many small ones lie in a few tasks.  Whole texts are packed by the cost
    of opening a file too.
    """
    texts = spark.read.text(paths, wholetext=True).select("value")
    found = spark.read.json(texts.rdd.map(lambda row: row[0])).schema
    return None if not len(found) or "_corrupt_record" in found.fieldNames() else found


class Batches(InputPartition):
    """A share of one file's record batches: every ``of``-th one from ``first``."""

    def __init__(self, path: str, first: int, of: int):
        self.path, self.first, self.of = path, first, of


class FeatherReader(DataSourceReader):
    """Record batches of Arrow files: only the wanted columns are decoded, and bounds drop rows before they reach Spark."""

    def __init__(self, options: dict, schema: StructType):
        self.paths = json.loads(options["paths"])
        self.share = int(options.get("bytes_per_partition", 16 << 20))
        self.names = schema.fieldNames()
        self.where = json.loads(options.get("where", "[]"))

    def partitions(self):
        """Shares of about ``bytes_per_partition`` by the files' sizes; no file is opened for this."""
        found = []
        for path in self.paths:
            system, base = open_root(path)
            info = system.get_file_info(base)
            infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
            for file in infos:
                if file.type == fs.FileType.File and not file.base_name.startswith(("_", ".")):
                    of = max(1, -(-file.size // self.share))
                    found += [Batches(_address(path, file.path), k, of) for k in range(of)]
        return found

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        system, base = open_root(partition.path)
        with system.open_input_file(base) as source:
            names = pa.ipc.open_file(source).schema.names
            bounds = [name for name, _, _ in self.where]
            wanted = {names.index(n) for n in [*self.names, *bounds]}
            file = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=sorted(wanted)))
            for k in range(partition.first, file.num_record_batches, partition.of):
                batch = file.get_batch(k)
                for name, test, value in self.where:
                    batch = batch.filter(ROW_TESTS[test](batch.column(name), value))
                if len(batch):
                    yield batch.select(self.names)


def _address(path: str, found: str) -> str:
    """The found file's place with the scheme of the path it was found by."""
    return f"file://{found}" if path.startswith("file:") else f"{path.partition('://')[0]}://{found}" if "://" in path else found


class FeatherSource(DataSource):
    """``spark.read.format("arrowfiles").schema(...).option("paths", '["..."]').load()``"""

    @classmethod
    def name(cls):
        return "arrowfiles"

    def reader(self, schema: StructType):
        return FeatherReader(self.options, schema)


def _read_feather(spark: SparkSession, paths: list[str], schema, columns: list[str] | None, where: list[tuple], share: int) -> DataFrame:
    """Feather files through Arrow, split at record batches; without a schema only the first file's header is read for it."""
    spark.dataSource.register(FeatherSource)
    places = [place for path in paths for place in _matches(path)]
    if schema is None:
        share_of = FeatherReader({"paths": json.dumps(places)}, StructType([])).partitions()
        if not share_of:
            raise ValueError("no feather file found")
        system, base = open_root(share_of[0].path)
        with system.open_input_file(base) as source:
            schema = from_arrow_schema(pa.ipc.open_file(source).schema.remove_metadata())
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if columns is not None:
        schema = StructType([schema[c] for c in columns])
    return (spark.read.format("arrowfiles").schema(schema).option("paths", json.dumps(places))
            .option("bytes_per_partition", share).option("where", json.dumps(where)).load())


def _matches(path: str) -> list[str]:
    """The places that a path with a glob in its last part means."""
    folder, name = posixpath.split(path)
    if not any(c in name for c in "*?["):
        return [path]
    system, base = open_root(folder)
    return sorted(_address(path, i.path) for i in system.get_file_info(fs.FileSelector(base)) if fnmatch.fnmatchcase(i.base_name, name))


def write_feather(df: DataFrame, path: str, rows_per_batch: int = 65_536) -> None:
    """A folder of Arrow files, one a task, of record batches of at most ``rows_per_batch`` rows. A repeated task writes its file again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(path)
        system.create_dir(base, recursive=True)
        writer, n = None, 0
        name = f"{base}/part-{TaskContext.get().partitionId():05}.feather"
        with system.open_output_stream(name) as sink:
            for batch in batches:
                writer = writer or pa.ipc.new_file(sink, batch.schema)
                for low in range(0, len(batch), rows_per_batch):
                    writer.write_batch(batch.slice(low, rows_per_batch))
                n += len(batch)
            if writer:
                writer.close()
        if not writer:
            system.delete_file(name)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_table(df: DataFrame, path: str) -> None:
    """Write .csv (with header) or .parquet; the result is a folder of part files."""
    kind = extension(path)
    if kind == ".csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("output_path must end with .csv or .parquet")


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV part with header: for final, small tables such as a run overview."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def read_contract(spark: SparkSession, text: str, kind: str = ".yaml") -> DataFrame:
    """(column, expected) from the text of a YAML or JSON contract."""
    parsed = yaml.safe_load(text) if kind in (".yaml", ".yml") else json.loads(text)
    if not isinstance(parsed, dict):
        raise ValueError("schema must be a mapping")
    rows = [(str(name), str(kind)) for name, kind in (parsed.get("columns") or {}).items()]
    return spark.createDataFrame(rows, "column string, expected string")
