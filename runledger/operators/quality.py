"""Dataset quality: shape, profile, contract check, freshness, merge and deduplication."""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import canonical, col, is_floating, is_integral, is_numeric, seconds_between, value_of
from ..functions.fixed_values import CONTRACT_TYPE_NAMES
from ..session import local_table

BUCKETS = 1024             # slices of an interval that may hold a quartile, per pass
FEW_VALUES = 2048          # an interval with at most so many values is listed value by value
COLUMNS_PER_PASS = 24
ACCURACY = 10_000
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

# Bytes per value of fixed-width types; text and binary count their bytes.
WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4,
          "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _bytes(field: T.StructField) -> Column:
    width = WIDTHS.get(field.dataType.simpleString())
    c = col(field.name)
    if width is not None:
        return F.when(c.isNotNull(), width).otherwise(0).cast("bigint")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    text = F.to_json(F.struct(c)) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) \
        else c.cast("string")
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _one_row(df: DataFrame, aggregates: list[Column]) -> dict:
    return df.agg(*aggregates).first().asDict()


def dataset_stats(df: DataFrame) -> DataFrame:
    """(column, position, dtype, rows, nulls, bytes), one row per column, in one pass."""
    fields = df.schema.fields
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        aggregates += [F.count(value_of(field)).alias(f"c{i}"), F.coalesce(F.sum(_bytes(field)), F.lit(0)).alias(f"b{i}")]
    entries = F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"),
        F.col("rows"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"b{i}").alias("bytes"))
        for i, f in enumerate(fields)])
    return df.agg(*aggregates).select(F.inline(entries))


def _exact_quartiles(df: DataFrame, fields: list[T.StructField], facts: dict[str, tuple]) -> dict:
    """Exact, linearly interpolated quartiles of any number of rows; facts: column -> (n, min, max).

    Every wanted rank starts in the interval from minimum to maximum.  One pass counts the
    equal-width slices of all such intervals, which tells the slice each rank lies in; its
    true bounds are the next interval.  Intervals shrink about a thousandfold a pass until
    they hold one value.  A pass is one aggregation that combines on the map side, so no
    row is shuffled and at most (intervals x slices) rows come back.
    """
    by_name = {f.name: f for f in fields}
    biggest = sys.float_info.max
    wanted, solved = {}, {}
    for name, (n, low, high) in facts.items():
        for p in QUARTILES.values():
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                wanted[(name, rank)] = (low, high, 0, n)
    while True:
        for key in [k for k, (low, high, _, _) in wanted.items() if low == high]:
            solved[key] = wanted.pop(key)[0]
        if not wanted:
            break
        intervals = sorted({(name, low, high, n) for (name, _), (low, high, _, n) in wanted.items()})
        # Bounds sit in constant arrays, looked up by column and interval: one short expression
        # for all columns stays small enough to be compiled well.
        starts, scales, by_column = [], [], {}
        for i, (name, low, high, n) in enumerate(intervals):
            # Halves keep the span finite even between the two ends of the number range.
            start, end = max(low, -biggest) / 2, min(high, biggest) / 2
            scale = BUCKETS / (end - start) if end > start else math.inf
            starts.append(start)
            scales.append(None if n <= FEW_VALUES or math.isinf(scale) else scale)   # None: list value by value
            by_column.setdefault(name, []).append((low, high, i))

        def at(constants: list, index: str, kind: str) -> Column:
            return F.element_at(F.array(*[F.lit(x).cast(kind) for x in constants]), F.col(index) + 1)

        value = F.col("value")
        tests = []
        for j in range(max(map(len, by_column.values()))):
            low, high, i = zip(*[spans[j] if j < len(spans) else (None, None, None) for spans in by_column.values()])
            tests.append(F.when((value >= at(low, "c", "double")) & (value <= at(high, "c", "double")), at(i, "c", "int")))
        finite = F.greatest(F.lit(-biggest), F.least(F.lit(biggest), value))
        part = F.floor((finite / 2 - at(starts, "id", "double")) * F.col("scale")).cast("int")
        found = (df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), value_of(by_name[name]).cast("double").alias("value")) for c, name in enumerate(by_column)])))
            .filter("value IS NOT NULL").withColumn("id", F.coalesce(*tests)).filter("id IS NOT NULL")
            .withColumn("scale", at(scales, "id", "double"))
            .select("id", "value", F.least(F.lit(BUCKETS - 1), part).alias("part"), F.when(F.col("scale").isNull(), value).alias("single"))
            .groupBy("id", "part", "single")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect())
        slices: dict[int, list] = {}
        for row in sorted(found, key=lambda r: r["low"]):
            slices.setdefault(row["id"], []).append(row)
        place = {(name, low, high): i for i, (name, low, high, _) in enumerate(intervals)}
        for key, (low, high, below, _) in wanted.items():
            for row in slices[place[(key[0], low, high)]]:
                if key[1] < below + row["n"]:
                    wanted[key] = (row["low"], row["high"], below, row["n"])
                    break
                below += row["n"]
    out = {}
    for name, (n, _, _) in facts.items():
        for label, p in QUARTILES.items():
            at = p * (n - 1)
            low, high = solved[(name, math.floor(at))], solved[(name, math.ceil(at))]
            out[(name, label)] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: dtype, rows, nulls, bytes and, for numbers, the usual summary.

    ``std`` is the sample deviation and quartiles interpolate linearly.  Everything but the
    quartiles comes from one aggregation; quartiles take a few counting passes, or a sketch
    when ``approx`` is set.
    """
    fields = df.schema.fields
    result: list[dict] = []
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        group = fields[start:start + COLUMNS_PER_PASS]
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for i, field in enumerate(group):
            value = value_of(field)
            aggregates += [F.count(value).alias(f"count{i}"), F.sum(_bytes(field)).alias(f"bytes{i}")]
            if is_numeric(field.dataType):
                value = value.cast("double")
                aggregates += [F.avg(value).alias(f"mean{i}"), F.stddev_samp(value).alias(f"std{i}"),
                               F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
                if approx:
                    aggregates.append(F.percentile_approx(value, list(QUARTILES.values()), ACCURACY).alias(f"q{i}"))
        row = _one_row(df, aggregates)
        numeric = {f.name: (row[f"count{i}"], row[f"min{i}"], row[f"max{i}"]) for i, f in enumerate(group)
                   if is_numeric(f.dataType) and row[f"count{i}"]}
        exact = {} if approx or not numeric else _exact_quartiles(df, group, numeric)
        for i, field in enumerate(group):
            entry = {"column": field.name, "position": start + i, "dtype": field.dataType.simpleString(),
                     "rows": row["rows"], "nulls": row["rows"] - row[f"count{i}"], "bytes": row[f"bytes{i}"] or 0}
            if is_numeric(field.dataType):
                entry.update(count=row[f"count{i}"], mean=row[f"mean{i}"], std=row[f"std{i}"],
                             min=row[f"min{i}"], max=row[f"max{i}"])
                sketch = row.get(f"q{i}")
                for j, label in enumerate(QUARTILES):
                    entry[label] = sketch[j] if sketch else exact.get((field.name, label))
            result.append(entry)
    schema = ("column string, position int, dtype string, rows bigint, nulls bigint, bytes bigint, count bigint, "
              "mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    names = [part.split()[0] for part in schema.split(", ")]
    return local_table(df.sparkSession, [tuple(r.get(n) for n in names) for r in result], schema)


def validate_schema(df: DataFrame, contract: DataFrame) -> DataFrame:
    """Contract violations (column, error, expected, actual); no rows means valid.

    ``contract`` holds (column, expected).  Only the schema is looked at, no data is read.
    A type may be spelled the Spark way or as the matching pandas dtype.
    """
    spark = df.sparkSession
    actual = [(f.name, f.dataType.simpleString(), CONTRACT_TYPE_NAMES.get(f.dataType.simpleString(), []))
              for f in df.schema.fields]
    found = local_table(spark, actual, "name string, actual string, spellings array<string>")
    joined = contract.join(found, contract["column"] == found["name"], "left")
    fits = (F.col("expected") == F.col("actual")) | F.array_contains("spellings", F.col("expected"))
    return (joined.withColumn("error", F.when(F.col("name").isNull(), "missing").when(~fits, "dtype_mismatch"))
            .filter(F.col("error").isNotNull())
            .select("column", "error", F.when(F.col("name").isNotNull(), F.col("expected")).alias("expected"), "actual"))


def freshness(df: DataFrame, by: list[str], timestamp: str, as_of: str | Column,
              stale_after_hours: float = 24) -> DataFrame:
    """Age of the newest row per group at ``as_of``; stale when strictly older than the bound."""
    if stale_after_hours < 0:
        raise ValueError("stale_after_hours must be >= 0")
    moment = F.to_timestamp_ntz(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return (df.groupBy(*by).agg(F.max(timestamp).alias("last_modified"))
            .withColumn("age_seconds", F.greatest(F.lit(0.0), seconds_between(F.col("last_modified"), moment)))
            .withColumn("is_stale", F.col("age_seconds") > F.lit(float(stale_after_hours * 3600))))


def _common_type(types: list[T.DataType]) -> T.DataType:
    distinct = list(dict.fromkeys(t.simpleString() for t in types))
    if len(distinct) == 1:
        return types[0]
    if all(is_integral(t) for t in types):
        return T.LongType()
    if all(is_integral(t) or is_floating(t) for t in types):
        return T.DoubleType()
    return T.StringType()


def merge(frames: list[DataFrame], deduplicate: bool = False) -> DataFrame:
    """Rows of all inputs, columns matched by name, gaps filled with NULL.

    Columns are widened before the union: numbers to a common number, anything else that
    differs to text.
    """
    if not frames:
        raise ValueError("need at least one dataset")
    seen: dict[str, list[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    target = {name: _common_type(types) for name, types in seen.items()}
    widened = [frame.select(*[col(f.name).cast(target[f.name]).alias(f.name) for f in frame.schema.fields])
               for frame in frames]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened)
    return dedup(merged) if deduplicate else merged


def dedup(df: DataFrame) -> DataFrame:
    """Distinct rows; NULL equals NULL and NaN equals NaN.  Copies combine on the map side."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    distinct = df.select(*canonical(df)).dropDuplicates()
    return distinct.select(*[F.map_from_entries(col(c)).alias(c) if c in maps else col(c) for c in df.columns])


def sample_rows(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key; Spark keeps only the ``n`` best of each partition."""
    return df.orderBy(*[col(k) for k in key]).limit(n)
