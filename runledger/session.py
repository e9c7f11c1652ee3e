"""Session factory, shared scratch space and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Bytes and rows of the batches in which whole texts go to Python workers.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def get_session(app_name: str = "runledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package expects; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="runledger-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_OWNERS: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet. The innermost :func:`scratch` owns it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the tables stored inside the block and delete them at its end.

    Put it round a query and the action that writes its result; results are lazy, so they can't be read afterwards.
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OWNERS.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder and go on from there.

    Lost executors then cost no recomputation, plans stay short, and the optimizer knows
    the true size.  (``checkpoint()`` would compute its last stage twice.)
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """Rows that are already on the driver as a local relation, whose true size Catalyst knows."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    records = [dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def spread(df: DataFrame) -> DataFrame:
    """Share a table read in very few pieces among all cores, before work that is heavy per row.

    A table with at least as many pieces as cores is left alone, so big inputs are never
    shuffled for this.  Meant for plain scans: asking for their pieces runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of a few megabytes, whatever the length of the texts: the session's batch limits are lowered."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(conf.get(key).rstrip("bB")) <= most:
            conf.set(key, most)
    return df.mapInArrow(function, schema)
