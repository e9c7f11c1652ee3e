"""Exact train/validation/test splits, plain and stratified.

Rows are ordered by a digest of their key and the seed; the first ``n_train`` go to
train, the next ``n_val`` to val, the rest to test.  No row is moved for this: only the
two digests at the borders are looked up (by counting digest prefixes, then counting
inside the one prefix a border falls into), and every row is labelled by comparing its own
digest with them.  The answer depends on keys and seed alone, not on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import canonical, col, is_floating, row_digest, value_of
from ..session import cut_lineage, local_table
from .ranks import running_total

PREFIX = 3             # hex digits per counting level: 4096 prefixes
FINE_ROWS = 1_000_000  # a border prefix above this many rows is counted one level deeper
CHUNK = 10_000


def split_sizes(n: int, train: float, val: float, test: float) -> tuple[int, int, int]:
    """Row counts of the three parts: train rounds down, then test of the rest rounds up."""
    if abs((train + val + test) - 1.0) > 1e-9:
        raise ValueError("train_ratio + val_ratio + test_ratio must equal 1.0")
    n_train = math.floor(n * train)
    rest = n - n_train
    n_test = math.ceil(rest * (test / (val + test))) if val + test > 0 else 0
    return n_train, rest - n_test, n_test


def quotas(strata: DataFrame, count: str, target: int, total: int, out: str) -> DataFrame:
    """Share ``target`` rows among strata by largest remainder; the shares add up exactly."""
    if total == 0 or target == 0:
        return strata.withColumn(out, F.lit(0).cast("bigint"))
    scaled = F.col(count).cast("decimal(18,0)") * F.lit(target).cast("decimal(18,0)")
    whole = F.lit(total).cast("decimal(18,0)")
    parts = (strata.withColumn("_left", (scaled % whole).cast("decimal(18,0)"))
             .withColumn("_base", ((scaled - F.col("_left")) / whole).cast("bigint")))
    spare = target - parts.agg(F.sum("_base")).first()[0]
    ranked = running_total(parts, [], [F.desc("_left"), F.asc("stratum")], out="_rank")
    return (ranked.withColumn(out, F.col("_base") + F.when(F.col("_rank") <= spare, 1).otherwise(0))
            .drop("_left", "_base", "_rank"))


def _straddling(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose running count range covers the wanted position ``k``; ``k`` becomes local."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .filter((F.col("k") > F.col("_before")) & (F.col("k") <= F.col("_before") + F.col("n")))
            .withColumn("k", F.col("k") - F.col("_before")).drop("_before"))


def _border_digests(base: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stratum, border, digest, k, n): the digest at each wanted rank, and its place among equals."""
    keys = ["stratum", "border"]
    depth = PREFIX
    found = cut_lineage(_straddling(counts.join(wanted, "stratum"), keys, "prefix"))
    while (found.agg(F.max("n")).first()[0] or 0) > FINE_ROWS and depth + PREFIX <= 30:
        deeper = (base.withColumn("prefix", F.substring("digest", 1, depth))
                  .join(found.select("stratum", "border", "prefix", "k"), ["stratum", "prefix"])
                  .groupBy("stratum", "border", "k", F.substring("digest", 1, depth + PREFIX).alias("prefix"))
                  .agg(F.count(F.lit(1)).alias("n")))
        depth += PREFIX
        before = found.agg(F.max("n")).first()[0]
        found = cut_lineage(_straddling(deeper, keys, "prefix"))
        if found.agg(F.max("n")).first()[0] == before:
            break      # one key holds the whole prefix; the count by digest below collapses it
    exact = (base.withColumn("prefix", F.substring("digest", 1, depth))
             .join(found.select("stratum", "border", "prefix", "k"), ["stratum", "prefix"])
             .groupBy("stratum", "border", "k", "digest").agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(_straddling(exact, keys, "digest"))


def _share_out(rows: DataFrame, names: list[str]) -> DataFrame:
    """Label rows that share one border digest: some go below the border, some above.

    Equal rows are counted, not listed; copies are written out again in small chunks, so
    even one row repeated over a third of the table is spread over all tasks.
    """
    source = rows.select(*[col(c) for c in names])
    groups = (rows.groupBy("_stratum", "_digest", "_train", "_val", row_digest(canonical(source)).alias("_row"))
              .agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[col(c) for c in names])).alias("_values")))
    placed = running_total(groups, ["_stratum", "_digest"], [F.col("_row")], F.col("_n"), "_end")
    start = F.col("_end") - F.col("_n")

    def below(limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(limit - start, F.col("_n")))

    train = below(F.col("_train"))
    upto_val = below(F.col("_train") + F.col("_val"))
    shares = F.array(F.struct(F.lit("train").alias("split"), train.alias("copies")),
                     F.struct(F.lit("val").alias("split"), (upto_val - train).alias("copies")),
                     F.struct(F.lit("test").alias("split"), (F.col("_n") - upto_val).alias("copies")))
    shared = placed.select("_row", "_values", F.inline(shares)).filter("copies > 0")
    chunks = shared.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))))
    size = F.least(F.lit(CHUNK), F.col("copies") - F.col("_chunk") * CHUNK)
    return (chunks.repartition(F.col("_row"), F.col("_chunk"), F.col("split"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
            .select("_values.*", "split"))


def split(df: DataFrame, key: list[str] | None = None, train_ratio: float = 0.7, val_ratio: float = 0.15,
          test_ratio: float = 0.15, stratify_column: str | None = None, random_seed: int = 42) -> DataFrame:
    """Add a column ``split`` with exactly the sizes of :func:`split_sizes`.

    ``key`` names the columns that identify a row (default: the whole row).  Rows with the
    same key are handled too.  With ``stratify_column`` every part keeps the class shares;
    missing values are a class of their own.
    """
    split_sizes(0, train_ratio, val_ratio, test_ratio)
    fields = {f.name: f for f in df.schema.fields}
    if stratify_column is not None and stratify_column not in fields:
        raise ValueError(f"stratify column not found: {stratify_column}")
    names = df.columns
    if key and len(key) == 1 and not is_floating(fields[key[0]].dataType):
        text = F.coalesce(col(key[0]).cast("string"), F.lit("<null>"))
    else:
        text = row_digest(canonical(df.select(*[col(c) for c in (key or names)])))
    stratum = F.lit("all")
    if stratify_column is not None:
        stratum = F.coalesce(F.concat(F.lit("="), value_of(fields[stratify_column]).cast("string")), F.lit("<null>"))
    marked = (df.withColumn("_digest", F.md5(F.concat(text, F.lit(f":{random_seed}"))))
              .withColumn("_stratum", stratum))
    base = marked.select(F.col("_stratum").alias("stratum"), F.col("_digest").alias("digest"))

    counts = cut_lineage(base.groupBy("stratum", F.substring("digest", 1, PREFIX).alias("prefix"))
                         .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_train, n_val, n_test = split_sizes(total, train_ratio, val_ratio, test_ratio)
    if stratify_column is None:
        shares = local_table(df.sparkSession, [("all", n_train, n_val)] if total else [], "stratum string, train bigint, val bigint")
    else:
        strata = cut_lineage(counts.groupBy("stratum").agg(F.sum("n").alias("rows")))
        shares = quotas(strata, "rows", n_train, total, "train").withColumn("rest", F.col("rows") - F.col("train"))
        shares = cut_lineage(quotas(shares, "rest", n_test, n_val + n_test, "test")
                             .withColumn("val", F.col("rest") - F.col("test")))
    wanted = shares.select("stratum", F.inline(F.array(
        F.struct(F.lit("train").alias("border"), F.col("train").alias("k")),
        F.struct(F.lit("val").alias("border"), (F.col("train") + F.col("val")).alias("k")))))
    borders = _border_digests(base, counts, wanted)

    # One row per stratum: both border digests, how many equals each has, how many stay below.
    cuts = cut_lineage(shares.select("stratum").join(
        borders.groupBy("stratum").pivot("border", ["train", "val"]).agg(
            F.first("digest").alias("digest"), F.first("k").alias("k"), F.first("n").alias("n")),
        "stratum", "left"))
    digest = F.col("_digest")
    if stratify_column is None:     # a single pair of borders: constants, no join
        border = cuts.first() or {}
        labelled = marked.withColumns({f.name: F.lit(border[f.name] if border else None).cast(f.dataType)
                                       for f in cuts.schema.fields if f.name != "stratum"})
    else:
        labelled = marked.join(cuts.withColumnRenamed("stratum", "_stratum"), "_stratum")
    label = (F.when(digest <= F.col("train_digest"), "train")
             .when(digest <= F.col("val_digest"), "val").otherwise("test"))
    if borders.filter("k < n").isEmpty():
        return labelled.select(*[col(c) for c in names], label.alias("split"))

    # Some key repeats and sits on a border: its rows are shared out between the parts.
    on_train, on_val = digest == F.col("train_digest"), digest == F.col("val_digest")
    torn = F.coalesce((on_train & (F.col("train_k") < F.col("train_n")))
                      | (on_val & (F.col("val_k") < F.col("val_n"))), F.lit(False))
    at_train = F.coalesce(F.when(on_train, F.col("train_k")), F.lit(0))
    at_val = F.when(on_val, F.col("val_k")).otherwise(F.col("train_n"))
    tied = labelled.filter(torn).withColumn("_train", at_train).withColumn("_val", at_val - F.col("_train"))
    clear = labelled.filter(~torn).select(*[col(c) for c in names], label.alias("split"))
    return clear.unionByName(_share_out(tied, names))


def split_stratified(df: DataFrame, stratify_column: str, **options) -> DataFrame:
    """:func:`split` that keeps the class shares of one column in every part."""
    return split(df, stratify_column=stratify_column, **options)


def split_counts(labelled: DataFrame, *by: str) -> DataFrame:
    """Rows per part (and per given column)."""
    return labelled.groupBy("split", *by).agg(F.count(F.lit(1)).alias("rows"))
