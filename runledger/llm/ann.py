"""Nearest neighbours over learned partitions.

* Learn, on a bounded sample (``sample_rows`` rows by hash): the sample's neighbour graph, its balanced partition (spectral
  bisection at the median, then moves that keep within capacity), and a small softmax classifier that predicts the part.
* Index: every row goes to its most probable part; a part is dealt into blocks of ``block_rows`` rows by the hash of the id,
  so a common vector or a large part never meets in one task.
* Search: a query goes to its most probable parts; how many is learned too: the fewest that reach ``target`` recall on the half
  of the sample that neither graph nor classifier saw.  Each block ranks its candidates by exact distance in double precision.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.  Repeated rows
of one id count once.  Ties go to the smaller id.  With fewer candidates than ``k`` all come back; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): vectors of the usual length with finite components that aren't all zero."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    usual = rows.groupBy(F.size("v").alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    return rows.filter(F.size("v") == (usual[0] if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _graph(shared, k: int):
    """(i, nearest): neighbours of sample rows within the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        norms = (base ** 2).sum(1)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for low in range(0, len(rows), 512):
                part = rows[low:low + 512]
                far = norms[None] - 2 * base[part] @ base.T
                far[np.arange(len(part)), part] = np.inf
                m = min(k, len(base) - 1)
                near = np.argpartition(far, m - 1, 1)[:, :m] if m else np.zeros((len(part), 0), int)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(near.tolist(), pa.list_(pa.int32()))], ["i", "near"])
    return run


def neighbour_graph(spark, sample: np.ndarray, k: int) -> np.ndarray:
    """The sample's k nearest neighbours, one row each; blocks of rows are tasks."""
    shared = spark.sparkContext.broadcast(sample)
    found = (spark.range(0, len(sample), 1, spark.sparkContext.defaultParallelism).withColumnRenamed("id", "i")
             .mapInArrow(_graph(shared, k), "i BIGINT, near ARRAY<INT>").toPandas().sort_values("i"))
    return np.array(found["near"].tolist(), int).reshape(len(sample), -1)


def bisect(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Balanced parts of the graph: halves by the second eigenvector, then moves that cut fewer edges within capacity."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    label, draw = np.zeros(n, int), np.random.default_rng(seed)
    width = 1
    while width < parts:
        new = label * 2
        for part in range(width):
            own = np.flatnonzero(label == part)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inner = (label[src] == part) & (label[dst] == part)
            s, t = place[src[inner]], place[dst[inner]]
            degree = np.bincount(s, minlength=len(own)) + 1e-9
            x = draw.standard_normal(len(own))
            for _ in range(80):
                x -= (x * degree).sum() / degree.sum()
                x = 0.5 * x + 0.5 * np.bincount(s, x[t], len(own)) / degree
                x /= max(np.abs(x).max(), 1e-12)
            new[own[np.argsort(x, kind="stable")[len(own) // 2:]]] += 1
        label, width = new, width * 2
    room, most = np.bincount(label, minlength=width), 1.05 * n / width + 1
    around = [[] for _ in range(n)]
    for i, j in zip(src.tolist(), dst.tolist()):
        around[i].append(j)
    for _ in range(6):
        moved = 0
        for i in draw.permutation(n):
            votes = np.bincount(label[around[i]], minlength=width) if around[i] else np.zeros(width, int)
            votes[room + 1 > most] = -1
            best = int(votes.argmax())
            if best != label[i] and votes[best] > (label[around[i]] == label[i]).sum():
                room[label[i]] -= 1
                room[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A softmax classifier over standardised vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, parts: int, rounds: int = 300) -> None:
        self.mean, self.spread = rows.mean(0), rows.std(0) + 1e-9
        x = np.hstack([(rows - self.mean) / self.spread, np.ones((len(rows), 1))])
        self.w, first, second = np.zeros((x.shape[1], parts)), 0.0, 0.0
        aim = np.eye(parts)[labels]
        for r in range(1, rounds + 1):
            z = x @ self.w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - aim) / len(x) + 1e-4 * self.w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            self.w -= 0.05 * (first / (1 - 0.9 ** r)) / (np.sqrt(second / (1 - 0.99 ** r)) + 1e-8)

    def order(self, rows: np.ndarray) -> np.ndarray:
        """Parts from most to least probable."""
        z = (rows - self.mean) / self.spread @ self.w[:-1] + self.w[-1]
        return np.argsort(-z, 1, kind="stable")


def learn(spark, sample: np.ndarray, parts: int, k: int, target: float) -> tuple[Router, int]:
    """The router, and how many parts a query must see for ``target`` recall."""
    half = max(1, len(sample) // 2)
    own = sample[:half]
    router = Router(own, bisect(neighbour_graph(spark, own, k), parts), parts)
    orders = router.order(sample)
    near = neighbour_graph(spark, sample, k)[half:]
    if not near.size:
        return router, parts
    rank = np.empty_like(orders)
    np.put_along_axis(rank, orders, np.arange(parts)[None], 1)
    seen = np.take_along_axis(rank[half:], orders[:, 0][near], 1)  # how late a neighbour's part comes for the query
    share = np.array([(seen <= p).mean() for p in range(parts)])
    return router, int(np.argmax(share >= target)) + 1 if share[-1] >= target else parts


def _assign(shared, probes: int):
    """id, v and the ``probes`` most probable parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            if len(batch):
                order = router.order(matrix(batch.column(1)))[:, :probes].astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "v", "parts"])
    return run


def _rank(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            base, ids = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["id"].to_numpy()
            norms = (base ** 2).sum(1)
            for low in range(0, len(queries), 256):
                part = queries.iloc[low:low + 256]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                far = norms[None] - 2 * q @ base.T + (q ** 2).sum(1)[:, None]
                for i, own in enumerate(part["id"].to_numpy()):
                    row = np.where(ids == own, np.inf, far[i])
                    # the k nearest ids, with room for repeated rows and for rounding
                    cut = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                    at = np.flatnonzero((row <= cut + 1e-9 * (1 + np.abs(norms).max())) & np.isfinite(row))
                    exact = np.sqrt(((base[at] - q[i]) ** 2).sum(1))
                    best = pd.DataFrame({"vec_id": ids[at], "score": exact}).sort_values(["score", "vec_id"]).drop_duplicates("vec_id")
                    if len(best) < k < len(row):
                        at = np.flatnonzero(np.isfinite(row))
                        exact = np.sqrt(((base[at] - q[i]) ** 2).sum(1))
                        best = pd.DataFrame({"vec_id": ids[at], "score": exact}).sort_values(["score", "vec_id"]).drop_duplicates("vec_id")
                    out.append(best.head(k).assign(query_id=own))
        return pd.concat(out)[["query_id", "vec_id", "score"]] if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 10, parts: int = 32,
           sample_rows: int = 8192, block_rows: int = 4096, target: float = 0.975) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, nearest first."""
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, key, column))
    asked = cut_lineage(usable(queries, key, column).dropDuplicates(["id"]))
    sample = rows.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    parts = 1 << max(0, min(parts, sample.num_rows // 64).bit_length() - 1)
    router, probes = learn(spark, matrix(sample.column("v").combine_chunks()), parts, k, target)
    shared = spark.sparkContext.broadcast(router)
    kind = "id BIGINT, v ARRAY<DOUBLE>, parts ARRAY<INT>"
    index = cut_lineage(rows.mapInArrow(_assign(shared, 1), kind).select("id", "v", F.col("parts")[0].alias("part")))
    routed = cut_lineage(asked.mapInArrow(_assign(shared, probes), kind).select("id", "v", F.explode("parts").alias("part")))
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    asks = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_chunks"))
    grid = sizes.join(asks, "part")  # one row per part: at most ``parts``
    left = (routed.join(F.broadcast(grid), "part").withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_chunks")))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("part", F.col("block").cast("bigint").alias("block"), "chunk", "id", "v"))
    right = (index.join(F.broadcast(grid), "part").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("_blocks")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select("part", "block", F.col("chunk").cast("bigint").alias("chunk"), "id", "v"))
    at = ["part", "block", "chunk"]
    found = (left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_rank(k), "query_id BIGINT, vec_id BIGINT, score DOUBLE")
             .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
