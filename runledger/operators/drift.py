"""Two-sample drift: Kolmogorov-Smirnov on numbers, L1 distance of frequencies on the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.types import StructType

from ..functions.columns import is_integral, is_numeric, kolmogorov_p, value_of
from ..functions.fixed_values import FREQUENCY_DISTANCE_LIMIT, KS_ALPHA
from ..session import local_table
from .ranks import running_total

# Real values carry a mark, so no text can be taken for the missing one.
NULL_CATEGORY, VALUE_MARK = "<null>", "="
# What tells values apart: numbers are either whole or real, everything else is text.
NUMBER_KEYS, TEXT_KEYS = ["column", "whole", "real"], ["column", "text"]
VALUE_KEYS = [*NUMBER_KEYS, "text"]
REPORT = ["column", "type", "ks_statistic", "p_value", "frequency_distance", "drift_detected", "reason"]


def plan_columns(reference: StructType, candidate: StructType, columns: list[str] | None = None) -> dict[str, str]:
    """Columns found on both sides, in reference order, and how to compare them: whole, real or text."""
    other = {f.name: f.dataType for f in candidate.fields}
    plan = {}
    for field in reference.fields:
        if field.name not in other or (columns is not None and field.name not in columns):
            continue
        types = (field.dataType, other[field.name])
        # Whole numbers are compared as such: beyond 2^53 a double would merge neighbours.
        plan[field.name] = "whole" if all(map(is_integral, types)) else "real" if all(map(is_numeric, types)) else "text"
    return plan


def value_entries(df: DataFrame, plan: dict[str, str], keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per value with the given keys (and the ``keep`` columns); missing numbers are left out."""
    fields = {f.name: f for f in df.schema.fields}
    entries = []
    for name, kind in plan.items():
        value = value_of(fields[name])
        if kind == "text" and isinstance(fields[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        nothing = F.lit(None)
        parts = {"column": F.lit(name), "whole": (value if kind == "whole" else nothing).cast("bigint"),
                 "real": (value if kind == "real" else nothing).cast("double"),
                 "text": F.coalesce(F.concat(F.lit(VALUE_MARK), value.cast("string")), F.lit(NULL_CATEGORY)) if kind == "text" else nothing.cast("string")}
        entries.append(F.struct(*[parts[k].alias(k) for k in keys]))
    some = " OR ".join(f"{k} IS NOT NULL" for k in keys if k != "column")
    return df.select(*keep, F.inline(F.array(*entries))).filter(some)


def value_counts(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """(column, whole, real, text, n): how often each value occurs; what a fixed reference can keep."""
    return value_entries(df, plan, VALUE_KEYS).groupBy(*VALUE_KEYS).agg(F.count(F.lit(1)).alias("n"))


def side_sizes(reference: DataFrame, candidate: DataFrame, plan: dict[str, str], counted: DataFrame | None = None) -> DataFrame:
    """(column, n, m): usable values per side; rows for text, non-missing values for numbers.

    One job for both sides that reads no text column.
    """
    def side(df: DataFrame) -> DataFrame:
        fields = {f.name: f for f in df.schema.fields}
        return df.agg(F.count(F.lit(1)).alias("rows"), *[
            F.count(value_of(fields[c])).alias(f"n{i}") for i, (c, kind) in enumerate(plan.items()) if kind != "text"])

    def usable(row) -> dict[str, int]:
        return {c: row["rows"] if kind == "text" else row[f"n{i}"] for i, (c, kind) in enumerate(plan.items())}

    if counted is None:
        both = side(reference).withColumn("side", F.lit(0)).unionAll(side(candidate).withColumn("side", F.lit(1)))
        n, m = (usable(row) for row in sorted(both.collect(), key=lambda r: r["side"]))
    else:
        n = {r["column"]: r["n"] for r in counted.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        m = usable(side(candidate).first())
    return local_table(reference.sparkSession, [(c, n.get(c, 0), m[c]) for c in plan], "column string, n bigint, m bigint")


def _compared(reference: DataFrame, candidate: DataFrame, plan: dict[str, str], keys: list[str], counted: DataFrame | None) -> DataFrame:
    """(keys, r, c): how often each value occurs on either side.

    Both sides go through one aggregation, so equal values meet before the shuffle and a
    value that fills a third of a side travels as one row per task.
    """
    if counted is None:
        left = value_entries(reference, plan, keys).withColumn("r", F.lit(1).cast("bigint"))
    else:
        left = counted.withColumnRenamed("n", "r")
    right = value_entries(candidate, plan, keys)
    both = left.select(*keys, "r", F.lit(0).cast("bigint").alias("c")).unionAll(
        right.select(*keys, F.lit(0).cast("bigint").alias("r"), F.lit(1).cast("bigint").alias("c")))
    return both.groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def drift_numeric(reference: DataFrame, candidate: DataFrame, columns: list[str],
                  counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(column, n, m, ks_statistic, p_value): two-sample KS of every column at once.

    Distinct values are counted and spread over range slices; inside a slice, window sums give its totals and the places where
    its own running gap peaks.  Adding the totals of the slices before it gives the gap of the whole column, so no slice ever needs the
    others and a column may be any number of slices.
    """
    plan = plan_columns(reference.schema, candidate.schema, columns)
    sizes = side_sizes(reference, candidate, plan, counted) if sizes is None else sizes
    values = _compared(reference, candidate, plan, NUMBER_KEYS, counted)
    sized = values.join(sizes.filter("n > 0 AND m > 0"), "column")
    inside = Window.partitionBy("column", "part").orderBy("whole", "real").rowsBetween(Window.unboundedPreceding, 0)
    running = (sized.repartitionByRange(*NUMBER_KEYS).withColumn("part", F.spark_partition_id())
               .select("column", "part", "n", "m", F.sum("r").over(inside).alias("r"), F.sum("c").over(inside).alias("c")))
    peak = F.struct((F.col("r") / F.col("n") - F.col("c") / F.col("m")).alias("gap"), "r", "c")
    slices = (running.groupBy("column", "part").agg(F.max("r").alias("r"), F.max("c").alias("c"), F.max(peak).alias("top"), F.min(peak).alias("low"))
              .select("column", "part", "r", "c", *[F.col(f"{w}.{x}").alias(f"{w}_{x}") for w in ("top", "low") for x in ("r", "c")]))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    r0, c0 = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("r", "c"))
    placed = slices.withColumn("r0", r0).withColumn("c0", c0).join(sizes, "column")

    def gap(which):
        return F.abs((F.col("r0") + F.col(f"{which}_r")) / F.col("n") - (F.col("c0") + F.col(f"{which}_c")) / F.col("m"))

    # One row per column: small enough to be broadcast whatever the tables hold.
    peaks = placed.groupBy("column").agg(F.max(F.greatest(gap("top"), gap("low"))).alias("ks_statistic"))
    return (sizes.join(F.broadcast(peaks), "column", "left")
            .withColumn("p_value", kolmogorov_p(F.col("ks_statistic"), F.col("n"), F.col("m"))))


def drift_categorical(reference: DataFrame, candidate: DataFrame, columns: list[str],
                      counted: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(column, frequency_distance): L1 distance of relative frequencies, values as text.

    Missing values form a category of their own.  Differences are added up as whole
    numbers (r*m - c*n), so the result does not depend on the order of addition.
    """
    plan = {c: "text" for c in plan_columns(reference.schema, candidate.schema, columns)}
    sizes = side_sizes(reference, candidate, plan, counted) if sizes is None else sizes
    values = _compared(reference, candidate, plan, TEXT_KEYS, counted)
    wide = "decimal(18,0)"
    gap = F.abs(F.col("r").cast(wide) * F.col("m").cast(wide) - F.col("c").cast(wide) * F.col("n").cast(wide))
    sums = values.join(sizes, "column").groupBy("column").agg(F.sum(gap).cast("double").alias("gap"))
    # An empty side has no frequencies: everything on the other side differs.
    one_empty, both_empty = (F.col("n") == 0) | (F.col("m") == 0), (F.col("n") + F.col("m")) == 0
    distance = (F.when(both_empty, 0.0).when(one_empty, 1.0)
                .otherwise(F.col("gap") / (F.col("n").cast("double") * F.col("m").cast("double"))))
    return sizes.join(F.broadcast(sums), "column", "left").select("column", distance.alias("frequency_distance"))


def drift_report(reference: DataFrame, candidate: DataFrame, columns: list[str] | None = None,
                 counted: DataFrame | None = None) -> DataFrame:
    """One row per column both sides have: which test ran, its figures and the verdict.

    ``counted`` may hold :func:`value_counts` of the reference, to compare many candidates
    with one reference without reading it again.
    """
    plan = plan_columns(reference.schema, candidate.schema, columns)
    numeric = [c for c, kind in plan.items() if kind != "text"]
    categorical = [c for c, kind in plan.items() if kind == "text"]

    sizes = side_sizes(reference, candidate, plan, counted)

    def kept(names):
        return None if counted is None else counted.filter(F.col("column").isin(names))

    def sized(names):
        return sizes.filter(F.col("column").isin(names))

    nothing = F.lit(None)
    parts = []
    if numeric:
        empty = (F.col("n") == 0) | (F.col("m") == 0)
        parts.append(drift_numeric(reference, candidate, numeric, kept(numeric), sized(numeric)).select(
            "column", F.lit("numeric").alias("type"), "ks_statistic", "p_value",
            nothing.cast("double").alias("frequency_distance"),
            F.when(~empty, F.col("p_value") < KS_ALPHA).alias("drift_detected"),
            F.when(empty, "empty_series").alias("reason")))
    if categorical:
        parts.append(drift_categorical(reference, candidate, categorical, kept(categorical), sized(categorical)).select(
            "column", F.lit("categorical").alias("type"), nothing.cast("double").alias("ks_statistic"),
            nothing.cast("double").alias("p_value"), "frequency_distance",
            (F.col("frequency_distance") > FREQUENCY_DISTANCE_LIMIT).alias("drift_detected"),
            nothing.cast("string").alias("reason")))
    if not parts:
        schema = ("column string, type string, ks_statistic double, p_value double, "
                  "frequency_distance double, drift_detected boolean, reason string")
        return local_table(reference.sparkSession, [], schema)
    report = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return report.select(*REPORT)


def window_drift(reference: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, column, type, ks_statistic, p_value, frequency_distance, drift_detected) of many windows against one reference.

    Both sides are counts as :func:`value_counts` gives them, ``windows`` with the columns ``by`` besides.  A window's gap peaks at one of
    its own values or just before it, so each window needs the reference's running count there only: values of all windows are placed
    among the reference's once, and no window meets values it does not have.  Categories that a window lacks add what its own leave of 1.
    """
    sizes = reference.groupBy("column").agg(F.sum("n").alias("n_reference"))
    totals = windows.groupBy(*by, "column").agg(F.sum("n").alias("m"), F.max(F.col("text").isNotNull()).alias("_text"))
    own = windows.filter("text IS NULL").groupBy("column", "whole", "real").agg(F.lit(0).cast("bigint").alias("r"))
    listed = reference.filter("text IS NULL").select("column", "whole", "real", F.col("n").alias("r"))
    placed = running_total(listed.unionByName(own).groupBy("column", "whole", "real").agg(F.sum("r").alias("r")), ["column"],
                           [F.col("whole"), F.col("real")], F.col("r"), "r_to")
    inside = running_total(windows.filter("text IS NULL").select(*by, "column", "whole", "real", F.col("n").alias("c")), [*by, "column"],
                           [F.col("whole"), F.col("real")], F.col("c"), "c_to")
    both = placed.select(*[F.col(k).alias(f"_{k}") for k in NUMBER_KEYS], "r", "r_to")
    met = [inside[k].eqNullSafe(both[f"_{k}"]) for k in NUMBER_KEYS]
    at = inside.join(both, met[0] & met[1] & met[2]).drop("_column", "_whole", "_real").join(sizes, "column").join(totals, [*by, "column"])
    n, m = F.col("n_reference"), F.col("m")
    gap = F.greatest(F.abs(F.col("r_to") / n - F.col("c_to") / m), F.abs((F.col("r_to") - F.col("r")) / n - (F.col("c_to") - F.col("c")) / m))
    numbers = at.groupBy(*by, "column").agg(F.max(gap).alias("ks_statistic"))

    named = windows.filter("text IS NOT NULL").select(*by, "column", "text", F.col("n").alias("c"))
    shares = (named.join(reference.filter("text IS NOT NULL").select("column", "text", F.col("n").alias("r")), ["column", "text"], "left")
              .join(sizes, "column").join(totals, [*by, "column"]).withColumn("r", F.coalesce("r", F.lit(0))))
    wide = "decimal(18,0)"
    apart = F.abs(F.col("r").cast(wide) * m.cast(wide) - F.col("c").cast(wide) * n.cast(wide)) - F.col("r").cast(wide) * m.cast(wide)
    texts = shares.groupBy(*by, "column").agg(F.sum(apart).cast("double").alias("_gap"))
    found = (totals.join(sizes, "column").join(numbers, [*by, "column"], "left").join(texts, [*by, "column"], "left")
             .withColumn("p_value", F.when(~F.col("_text"), kolmogorov_p(F.col("ks_statistic"), n, m)))
             .withColumn("frequency_distance", F.when(F.col("_text"), 1 + F.col("_gap") / (n.cast("double") * m.cast("double")))))
    return found.select(*by, "column", F.when(F.col("_text"), "categorical").otherwise("numeric").alias("type"), "ks_statistic", "p_value", "frequency_distance",
                        F.when(F.col("_text"), F.col("frequency_distance") > FREQUENCY_DISTANCE_LIMIT).otherwise(F.col("p_value") < KS_ALPHA).alias("drift_detected"))
