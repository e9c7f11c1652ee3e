"""What several operators share: reading tables, stored intermediates, names that never clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, cut_lineage, in_arrow, local_table, scratch_path, shared_dir, spread  # noqa: F401  (re-exported for the operators)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids lie in no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def slots(df: DataFrame, group: str, order: list[Column], out: str, per_slice: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Rows fall into slices by the hash of ``order``; each slice numbers its own rows, after the rows of the slices before it.
    """
    from pyspark.sql import Window

    rows = df.count()
    slices = max(1, -(-rows // per_slice))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(group, "_slice").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
               .drop("count"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    return (cut.withColumn("_row", F.row_number().over(inside)).join(offsets, [group, "_slice"])
            .withColumn(out, F.col("_row") - 1 + F.col("_before")).drop("_slice", "_row", "_before"))
