"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

* Targets: each source gets its weight's share of all words, at most ``epochs`` times its own words; what a source cannot
  take is shared out again by weight among the others until none is above.
* Quotas: the targets are seats.  Blocks of ``block_words`` words go to the sources with the highest quotients
  target / (2k + 1), then each source's blocks go the same way to its shards.  A shard is the part of a source that one task
  numbers, so a hot source is many shards.
* Selection: a shard's documents lie on a line in seeded order.  Its quota is taken as whole passes over the line and then
  a run of blocks from a seeded place, so no document is taken more than ``epochs`` times.

Nulls: a null text has no words, a null source is a source (the last).  Documents without words take nothing.  Repeated rows
each count.  An empty table gives an empty mix.  Everything but the scan of the texts works on (id, source, words) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def _seats(df: DataFrame, group: list[str], value: str, seats: str, tie: list[str], out: str) -> DataFrame:
    """Sainte-Lague per group: the ``seats`` highest quotients value / (2k + 1); one row per party comes back with ``out``.

    A divisor a little above the average seat gives each party seats it holds for certain; at most about two per party are
    left, and only those quotients are ranked.
    """
    span = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(span), F.sum(value).over(span)
    spare = F.greatest(F.col("_s") - F.col("_n") / 2, F.lit(0.0))
    sized = df.withColumn("_s", F.col(seats).cast("double")).withColumn("_n", n.cast("double")).withColumn("_t", total.cast("double"))
    share = F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(0.0)
    held = (sized.withColumn("_low", F.greatest(F.floor(share * spare + 0.5 - 1e-9), F.lit(0)))
            .withColumn("_high", F.floor(share * (F.col("_s") + F.col("_n") / 2) + 0.5 + 1e-9)))
    left = F.col("_s") - F.sum("_low").over(span)
    asked = (held.withColumn("_left", left)
             .select(*group, *tie, value, "_left", F.explode(F.sequence("_low", F.greatest("_high", "_low"))).alias("_k"))
             .filter((F.col(value) > 0) & (F.col("_left") > 0)))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(value) / (2 * F.col("_k") + 1)), *tie)
    won = (asked.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= F.col("_left"))
           .groupBy(*group, *tie).agg(F.count(F.lit(1)).alias("_won")))
    keys = list(dict.fromkeys(group + tie))
    return (held.join(won, keys, "left").withColumn(out, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("bigint"))
            .drop("_s", "_n", "_t", "_low", "_high", "_won"))


def targets(sources: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """Add ``target`` to one row per source (``_key``, ``_order``, ``source_size``): a table as long as there are sources.

    Sorted by the level at which a source is full (epochs * size / weight), the full ones are a prefix; the level of the
    rest follows from running sums.
    """
    everything = Window.partitionBy("_all")
    rank = F.row_number().over(everything.orderBy("_order"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * epochs
    rows = (sources.withColumn("_all", F.lit(0)).withColumn("_rank", rank).withColumn("_weight", weight)
            .withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("_weight")))
    up = everything.orderBy("_full", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    level = ((total - F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(up), F.lit(0.0))))
    # a source is open if the level seen from it leaves room below its cap; once one is open, all later ones are
    seen = rows.withColumn("_level", level).withColumn("_open", F.col("_level") < F.col("_full"))
    common = F.min(F.when(F.col("_open"), F.struct("_full", "_rank", "_level"))).over(everything)["_level"]
    return (seen.withColumn("target", F.when(F.col("_open"), F.col("_weight") * common).otherwise(F.col("_cap")))
            .drop("_all", "_rank", "_weight", "_cap", "_full", "_level", "_open"))


def _between(low: Column, high: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.least(high, end) - F.greatest(low, start), F.lit(0))


def mix(documents: DataFrame, weights: list[int] = (1, 2, 3), epochs: int = 3, block_words: int = 16,
        shard_words: int = 4_000_000, shard_rows: int = 100_000, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, quota (blocks of its shard), taken."""
    # A key that is never null, for joins and grouping.
    sizes = cut_lineage(documents.select("doc_id", F.col("source").cast("string").alias("source"),
                                         F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
                        .withColumn("_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
                        .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size")))
    rows, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, -(-words // shard_words), -(-rows // shard_rows))
    dealt = sizes.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_hash"), F.lit(shards)))
    parts = dealt.groupBy("_key", "_shard").agg(F.sum("size").alias("_line"))
    per_source = (parts.groupBy("_key").agg(F.sum("_line").alias("source_size"))
                  .withColumn("_order", F.struct((F.col("_key") == "n").alias("last"), F.col("_key").alias("name"))))
    aimed = targets(per_source, list(weights), epochs).withColumn("_all", F.lit(0))
    blocks = (aimed.withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy("_all")) / block_words)))
    sources = _seats(blocks, ["_all"], "target", "_blocks", ["_key"], "_seats").drop("_all", "_blocks", "_order")
    quotas = (_seats(parts.join(sources, "_key"), ["_key"], "_line", "_seats", ["_shard"], "quota").drop("_seats"))
    # words the shard gives; the run starts at a seeded block of the line
    takes = (quotas.withColumn("_take", F.least(F.col("quota") * block_words, F.col("_line") * epochs))
             .withColumn("_passes", F.when(F.col("_line") > 0, F.floor(F.col("_take") / F.col("_line"))).otherwise(0))
             .withColumn("_rest", F.col("_take") - F.col("_passes") * F.col("_line"))
             .withColumn("_from", block_words * F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_shard"),
                                                       F.greatest(F.ceil(F.col("_line") / block_words), F.lit(1)))))
    line = Window.partitionBy("_key", "_shard").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.filter("size > 0").withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    begin, stop, length = F.col("_from"), F.col("_from") + F.col("_rest"), F.col("_line")
    run = (_between(F.col("_start"), F.col("_end"), begin, F.least(stop, length))
           + _between(F.col("_start"), F.col("_end"), F.lit(0), stop - length))
    taken = (placed.join(takes, ["_key", "_shard"])
             .withColumn("taken", (F.col("size") * F.col("_passes") + run).cast("bigint")))
    empty = (dealt.filter("size = 0").join(sources, "_key").withColumn("taken", F.lit(0).cast("bigint"))
             .withColumn("quota", F.lit(None).cast("bigint")))
    columns = ["doc_id", "source", "size", "source_size", "target", "quota", "taken"]
    return taken.select(*columns).unionByName(empty.select(*columns))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns kept: each appears as often as its taken words, to the nearest whole copy.

    Rows with the same doc_id share their taken words by their own number of words.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), words.alias("_size"))
    plan = (mix(documents, **options).groupBy("doc_id", "size").agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
            .filter("_taken > 0")
            .select("doc_id", "size", F.round(F.col("_taken") / F.col("size") / F.col("_rows")).cast("int").alias("_copies"))
            .filter("_copies > 0"))
    return (rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*"))
