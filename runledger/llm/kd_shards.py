"""Shards of near equal bytes from a k-d tree over the texts' metadata.

The tree's dimensions are bytes, lines and non-ASCII bytes of a text, so equal texts are one point and stay together.  Each
node is cut along its widest dimension at the weighted median (the point that splits its bytes as its leaves need), until a
node is one leaf.  Medians are found for all nodes of a level at once by counting bytes in ``BINS`` equal pieces of the
interval a median lies in; the driver sees at most nodes x BINS sums, never rows.  Equal values are told apart by the hash of
the text.

Hot groups: equal texts that fill over 1/64 of a leaf (so at most 64 per leaf) are dealt to the leaf with the fewest bytes
first, whole; only a group larger than a leaf is dealt in pieces by doc_id.  The tree then fills up what the leaves lack.

A null text has no bytes, as an empty one; both count one byte (the end mark).  Repeated rows each count.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import local_table
from .common import cut_lineage, slots

BINS = 4096
TIE_BITS = 31
HEAVY_SHARE = 64
DIMENSIONS = ("_bytes", "_lines", "_foreign")


def _points(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    size = F.octet_length(text).cast("bigint")
    lines = size - F.octet_length(F.translate(text, "\n", "")).cast("bigint")
    return cut_lineage(documents.select(
        "doc_id", (size + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        size.alias("_bytes"), lines.alias("_lines"), (size - F.length(text)).alias("_foreign")))


def _heavy(points: DataFrame, leaf: float, shards: int) -> tuple[list[tuple], list[float]]:
    """Pieces of hot groups as (hash, crc, size, pieces, piece, shard), and the bytes each shard got by them."""
    key = ["_hash", "text_crc32", "size"]
    load, rows = [0.0] * shards, []
    pieces = []
    found = (points.groupBy(*key).agg(F.sum("size").alias("_all")).filter(F.col("_all") > leaf / HEAVY_SHARE))
    for h, crc, size, total in found.collect():
        n = 1 if total <= leaf else int(-(-4 * total // leaf))
        pieces += [(total / n, h, crc, size, n, i) for i in range(n)]
    for weight, h, crc, size, n, i in sorted(pieces, key=lambda p: (-p[0], p[1:])):
        shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += weight
        rows.append((h, crc, size, n, i, shard))
    return rows, load


def _coordinate(dimension: Column) -> Column:
    tie = F.col("_hash").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    value = F.lit(None).cast("bigint")
    for i, name in reversed(list(enumerate(DIMENSIONS))):
        value = F.when(dimension == i, F.col(name)).otherwise(value)
    return F.shiftleft(value, TIE_BITS) + tie


def _descend(points: DataFrame, cuts: list[list[tuple]]) -> DataFrame:
    """The node of each point after the levels cut so far: (node, dimension, cut, left, right)."""
    spark, placed = points.sparkSession, points.withColumn("_node", F.lit(0))
    for level in cuts:
        split = local_table(spark, level, "_node INT, _dim INT, _cut BIGINT, _left INT, _right INT")
        below = _coordinate(F.col("_dim")) <= F.col("_cut")
        placed = (placed.join(split, "_node", "left")
                  .withColumn("_node", F.when(F.col("_dim").isNull(), F.col("_node")).when(below, F.col("_left")).otherwise(F.col("_right")))
                  .drop("_dim", "_cut", "_left", "_right"))
    return placed


def _medians(placed: DataFrame, wanted: dict[int, tuple[int, int, int, float]], slack: float) -> dict[int, int]:
    """node -> cut: the coordinate up to which the node's bytes come nearest to what is wanted.

    ``wanted``: node -> (dimension, lowest, highest coordinate, bytes to lie at or below the cut).
    """
    spark, cuts = placed.sparkSession, {}
    state = {n: [d, low, high, need] for n, (d, low, high, need) in wanted.items()}
    while state:
        rows = [(n, d, low, high, -(-(high - low + 1) // BINS)) for n, (d, low, high, _) in state.items()]
        ask = local_table(spark, rows, "_node INT, _dim INT, _low BIGINT, _high BIGINT, _width BIGINT")
        c = _coordinate(F.col("_dim"))
        sums = (placed.join(ask, "_node").withColumn("_c", c).filter("_c BETWEEN _low AND _high")
                .groupBy("_node", F.expr("(_c - _low) DIV _width").alias("_bin")).agg(F.sum("size").alias("_sum")).collect())
        for n, _, low, high, width in rows:
            need, at = state[n][3], 0.0
            for b, weight in sorted((r[1], r[2]) for r in sums if r[0] == n):
                if at + weight >= need:
                    break
                at += weight
            start, end = low + b * width, min(high, low + (b + 1) * width - 1)
            if width == 1 or weight <= slack:
                cuts[n] = end if at + weight - need <= need - at else start - 1
                del state[n]
            else:
                state[n][1:] = [start, end, need - at]
    return cuts


def shard(documents: DataFrame, shards: int = 8, slack: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; ``slack``: the share of a leaf by which a cut may miss its median.

    The number of shards is a parameter, so what the driver holds (nodes, bins, hot groups) is bounded by it alone.
    """
    points = _points(documents)
    spark = points.sparkSession
    total = points.agg(F.sum("size")).first()[0] or 0
    leaf = max(total / shards, 1.0)
    heavy, load = _heavy(points, leaf, shards)
    hot = local_table(spark, heavy, "_hash BIGINT, text_crc32 BIGINT, size BIGINT, _pieces INT, _piece INT, _hot INT")
    counts = hot.select("_hash", "text_crc32", "size", "_pieces").distinct()
    piece = F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int")
    marked = cut_lineage(points.join(counts, ["_hash", "text_crc32", "size"], "left").withColumn("_piece", piece)
                         .join(hot.drop("_pieces"), ["_hash", "text_crc32", "size", "_piece"], "left").drop("_pieces", "_piece"))
    light = marked.filter(F.col("_hot").isNull())

    lack = [max(leaf - x, 0.0) for x in load]
    nodes, cuts, names = {0: (0, shards)}, [], 1
    extent = None
    while any(high - low > 1 for low, high in nodes.values()):
        placed = _descend(light, cuts)
        boxes = {r["_node"]: r for r in placed.groupBy("_node").agg(
            F.sum("size").alias("_sum"), *[f(d).alias(f"{n}{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).collect()}
        if extent is None and 0 in boxes:
            extent = [max(boxes[0][f"high{d}"] - boxes[0][f"low{d}"], 1) for d in DIMENSIONS]
        wanted, open_nodes = {}, [n for n, (low, high) in nodes.items() if high - low > 1]
        for n in open_nodes:
            if n in boxes:
                low, high = nodes[n]
                box, all_lack = boxes[n], sum(lack[low:high])
                wide = max(range(len(DIMENSIONS)), key=lambda i: ((box[f"high{DIMENSIONS[i]}"] - box[f"low{DIMENSIONS[i]}"]) / extent[i], -i))
                share = sum(lack[low:(low + high) // 2]) / all_lack if all_lack else 0.5
                d = DIMENSIONS[wide]
                wanted[n] = (wide, box[f"low{d}"] << TIE_BITS, ((box[f"high{d}"] + 1) << TIE_BITS) - 1, box["_sum"] * share)
        medians, level = _medians(placed, wanted, slack * leaf), []
        for n in open_nodes:
            low, high = nodes.pop(n)
            left, right, names = names, names + 1, names + 2
            nodes[left], nodes[right] = (low, (low + high) // 2), ((low + high) // 2, high)
            if n in medians:
                level.append((n, wanted[n][0], medians[n], left, right))
        cuts.append(level)

    leaves = local_table(spark, [(n, low) for n, (low, _) in nodes.items()], "_node INT, _leaf INT")
    placed = _descend(marked, cuts).join(leaves, "_node", "left")
    done = cut_lineage(placed.select("doc_id", "size", "text_crc32", "_hash", F.coalesce("_hot", "_leaf").alias("shard")))
    return slots(done, "shard", [F.col("doc_id"), F.col("_hash")], "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))
