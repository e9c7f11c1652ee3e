"""Order inside groups without ever putting one big group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

def _slices(df: DataFrame, keys: list[str], order: list[Column], label: str = "_slice") -> DataFrame:
    """The rows spread by range over (keys, order) and stored, with the number of their range.

    A range is a contiguous piece of every group it touches, so a hot group is many pieces.
    """
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(label, F.spark_partition_id()))


def _same(keys: list[str]) -> Column:
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return same


def running_total(df: DataFrame, keys: list[str], order: list[Column], weight: Column | None = None,
                  out: str = "rank", how: str = "sum") -> DataFrame:
    """Inclusive running sum (or maximum) of ``weight`` per group; a rank when every weight is 1.

    ``order`` must tell the rows of a group apart.  Every piece of a group needs only its own running fold and the fold of
    the pieces before it; the table of pieces has at most (groups + ranges) rows.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    fold = {"sum": F.sum, "max": F.max}[how]
    pieces = _slices(df.withColumn("_weight", weight), keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy(*keys, "_slice").agg(fold("_weight").alias("_fold"))
               .withColumn("_offset", fold("_fold").over(before))
               .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), "_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = fold("_weight").over(inside)
    joined = own + F.coalesce(F.col("_offset"), F.lit(0)) if how == "sum" else F.greatest(own, F.col("_offset"))
    return (pieces.join(offsets, _same(keys)).withColumn(out, joined)
            .drop("_slice", "_weight", "_s", "_offset", *[f"_k_{k}" for k in keys]))


def previous_in_group(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Value of the row before, per group: within a piece of the group by a window, across pieces from the piece before."""
    pieces = _slices(df, keys, [F.col(order)])
    ends = (pieces.groupBy(*keys, "_slice").agg(F.max_by(value, order).alias("_end"))
            .withColumn("_earlier", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")))
            .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), "_earlier"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (pieces.join(ends, _same(keys))
            .withColumn(out, F.when(F.row_number().over(inside) == 1, F.col("_earlier")).otherwise(F.lag(value).over(inside)))
            .drop("_slice", "_s", "_earlier", *[f"_k_{k}" for k in keys]))


def latest_by(df: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """Last value per key by ``seq``: one aggregation that combines on the map side."""
    return df.groupBy(*keys).agg(*[F.max_by(v, seq).alias(v) for v in values], F.max(seq).alias(seq))


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """First ``keep`` rows per group.

    Spark prunes every input partition to ``keep`` rows per group before it shuffles, so
    a hot group costs no more than a cold one.
    """
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).filter(F.col("_row") <= keep).drop("_row")
