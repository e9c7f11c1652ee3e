"""Reachability and cycles in large directed graphs, by binary lifting over stored tables.

Links are rows (src, dst), optionally with key columns that keep many graphs apart.  ``jumps`` of level k are the pairs that a walk of
exactly 2^k links joins: level k + 1 is level k joined with itself.  On chains, rings and ladders a level is no larger than the links,
and a graph of depth n takes about log2 n rounds.  Where the next level could exceed ``GROWTH`` times the links and the answer so far
(counted before it is made), doubling stops and the walk goes on in steps of the last level, so no stored table outgrows both.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

GROWTH = 8
#: Stored tables of a walk before they are put together.
PIECES = 12


def compose(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, src, dst) of a pair of ``left`` followed by one of ``right``."""
    far = right.select(*keys, F.col("src").alias("_mid"), F.col("dst").alias("_far"))
    return (left.withColumnRenamed("dst", "_mid").join(far, [*keys, "_mid"])
            .select(*keys, "src", F.col("_far").alias("dst")).distinct())


def pairs_at_most(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> float:
    """How many pairs :func:`compose` may make: for each node between, those that end there times those that begin there."""
    ends = left.groupBy(*keys, F.col("dst").alias("_mid")).agg(F.count(F.lit(1)).alias("_ends"))
    starts = right.groupBy(*keys, F.col("src").alias("_mid")).agg(F.count(F.lit(1)).alias("_starts"))
    return ends.join(starts, [*keys, "_mid"]).agg(F.sum(F.col("_ends").cast("double") * F.col("_starts"))).first()[0] or 0.0


def reach(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that a walk from a start (``node``) leads to, the start itself included.

    Round k adds what lies 2^k to 2^(k+1) - 1 links away: all pairs so far, followed by a jump of level k.  After doubling has stopped,
    only the pairs of the last round go on, a jump of that level at a time.  A round that adds nothing is the last.
    """
    jumps = cut_lineage(links.select("src", "dst").distinct())
    n_links = n_known = jumps.count()
    pieces = [cut_lineage(starts.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())]
    doubling = True
    while True:
        known = reduce(DataFrame.unionByName, pieces)
        going = known if doubling else pieces[-1]
        added = cut_lineage(compose(going, jumps).join(known, ["src", "dst"], "left_anti"))
        n_added = added.count()
        if not n_added:
            return known.select(F.col("src").alias("start"), F.col("dst").alias("node"))
        n_known += n_added
        pieces.append(added)
        if len(pieces) > PIECES:
            pieces = [cut_lineage(reduce(DataFrame.unionByName, pieces[:-1])), added]
        if doubling:
            doubling = pairs_at_most(jumps, jumps) <= GROWTH * (n_links + n_known)
            if doubling:
                jumps = cut_lineage(compose(jumps, jumps))


def cyclic(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct ``keys`` of graphs that have a cycle, however deep they are.

    A walk of more links than a graph has repeats one.  Where doubling has to stop earlier, nodes that no walk of that length leaves or
    enters lie on no cycle; they go, and the rest starts anew.  A graph that loses nothing has a cycle, as every node leads on.
    """
    at = list(keys)
    left, found = cut_lineage(links.select(*at, "src", "dst").distinct()), None
    while True:
        sizes = left.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        n_links, longest = sizes.agg(F.sum("_n"), F.max("_n")).first()
        if not n_links:
            break
        jumps, length = left, 1
        while length <= longest and jumps is not None and pairs_at_most(jumps, jumps, at) <= GROWTH * n_links:
            jumps, length = cut_lineage(compose(jumps, jumps, at)), 2 * length
            if jumps.isEmpty():
                jumps = None
        if jumps is None:
            break
        if length > longest:
            certain, left = jumps.select(*at).distinct(), None
        else:
            inside = cut_lineage(jumps.select(*at, F.col("src").alias("node")).intersect(jumps.select(*at, F.col("dst").alias("node"))))
            kept = (left.join(inside.withColumnRenamed("node", "src"), [*at, "src"], "left_semi")
                    .join(inside.withColumnRenamed("node", "dst"), [*at, "dst"], "left_semi").select(*at, "src", "dst"))
            kept = cut_lineage(kept)
            same = kept.groupBy(*at).agg(F.count(F.lit(1)).alias("_kept")).join(sizes, at)
            certain = cut_lineage(same.filter("_kept = _n").select(*at))
            left = cut_lineage(kept.join(certain, at, "left_anti"))
        found = certain if found is None else found.unionByName(certain)
        if left is None:
            break
    return links.select(*at).limit(0) if found is None else found.distinct()
