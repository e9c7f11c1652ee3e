"""Quality scores by a linear model over n-gram indicators scaled by naive Bayes log-count ratios.

* Features: which byte n-grams (1 to 4 bytes) a text has, hashed to 2^17 buckets, and whether a word repeats; a bucket's value is the log ratio of the
  shares of high and low quality training rows that have it, and rows have length one.
* Fit: hinge loss by dual coordinate descent.  Training rows lie in one stored table and are dealt, each label by itself, to
  blocks of about ``block_rows`` rows in the order of a seeded hash; a task fits a model on each of its blocks, and the mean
  over all blocks is the model.  So all labelled rows are used wherever they lie, every block has both labels (rows of a label
  with fewer rows than blocks stand in several), no task holds more than a block, and the driver gets 2^17 numbers.
* Scores: a logistic curve over the margin, fitted on one fold of the training rows that the weights never saw.

Rows with null id, text or quality are not learned from.  Null and empty texts are scored like a text without n-grams.
Without examples of both kinds every score is the share of good ones (0.5 without any).  Repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, fold, in_arrow, slots
from .textblocks import RunHash, blocks, rows_of, spans

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3, 4)
#: Buckets of the word n-grams "x x" and "x x x": the same word, whichever it is, two or three times in a row.
TWICE, THRICE = BUCKETS - 1, BUCKETS - 2
WORD_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
HELD_OUT, CURVE_FOLD, FOLDS = 0, 1, 5
BINS, REACH = 4000, 8.0
BROADCAST_ROWS = 2_000_000
FIT_TASKS = 4096


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    seen, words = np.zeros(BUCKETS, bool), RunHash(404)
    for low, high, rows, data in blocks(column):
        starts, ends = spans(data, rows, WORD_BYTES)
        word, owner = words(data, starts, ends), rows_of(starts, rows)
        again = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[1:][again], minlength=high - low)
        thrice = np.bincount(owner[2:][again[1:] & again[:-1]], minlength=high - low)
        codes = []
        for n in ORDERS:
            size = max(len(data) - n + 1, 0)
            code = np.full(size, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ data[k:k + size]
            code *= np.uint32(0x9E3779B1)
            codes.append((code ^ code >> np.uint32(15)) >> np.uint32(32 - BUCKET_BITS))
        for start, end, two, three in zip(rows[:-1].tolist(), rows[1:].tolist(), repeats.tolist(), thrice.tolist()):
            for n, code in zip(ORDERS, codes):
                seen[code[start:max(end - n + 1, start)]] = True
            seen[TWICE], seen[THRICE] = two > 0, three > 0
            at = np.flatnonzero(seen)
            seen[at] = False
            yield at.astype(np.int32)


def packed(at: np.ndarray) -> bytes:
    """Ascending buckets as their steps, a byte each; a byte 255 adds to the step that ends behind it."""
    more, last = np.divmod(np.diff(at, prepend=0), 255)
    out = np.full(len(at) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    return out.tobytes()


def unpacked(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int32)[steps != 255]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 2000):
            part = batch.slice(low, 2000)
            yield pa.RecordBatch.from_arrays([pa.array(map(packed, indicators(part.column(0))), pa.binary()), *part.columns[1:]],
                                             ["at", *part.schema.names[1:]])


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for steps in batch.column(0):
        yield unpacked(np.frombuffer(steps.as_buffer(), np.uint8))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros((2, BUCKETS + 1), np.int64), 0
    for batch in batches:
        for at, good in zip(_rows(batch), batch.column(1).to_pylist()):
            total[int(good), at + 1] += 1
            total[int(good), 0] += 1
    for good in (0, 1):
        at = np.flatnonzero(total[good])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), good, np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total[good, at])],
                                         ["good", "bucket", "n"])


def descend(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, costs: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the last weight is the constant's."""
    weights, alphas = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    values = []
    for at in rows:
        v = ratios[at]
        values.append(v / max(np.sqrt(v @ v), 1e-9))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            at, v, y = rows[i], values[i], signs[i]
            slope = y * (weights[at] @ v + weights[-1]) - 1
            new = min(max(alphas[i] - slope / 2.0, 0.0), costs[i])
            step = new - alphas[i]
            if step:
                weights[at] += step * y * v
                weights[-1] += step * y
                alphas[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def deal(learn: DataFrame, docs: np.ndarray, block_rows: int) -> DataFrame:
    """row, block, slot: the blocks of each training row (row, key, good). ``docs``: rows with good = 0 and 1, none of them zero.

    Each label is dealt out by turns in the order of ``key``. A label with fewer rows than there are blocks goes round again.
    """
    count = int(max(1, min(docs.sum() // block_rows, docs.max())))
    numbered = slots(learn.select("row", "key", "good"), "good", [F.col("key")], "slot")
    step = F.when(F.col("good"), F.lit(int(docs[1]))).otherwise(F.lit(int(docs[0])))
    places = F.sequence(F.pmod("slot", F.lit(count)).cast("bigint"), F.lit(count - 1).cast("bigint"), step.cast("bigint"))
    return numbered.select("row", "slot", F.explode(places).alias("block"))


def _fit(ratios, cost: float, rounds: int):
    """Adds up the models of the blocks; rows (at, good, block) come block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, models, now = np.zeros(BUCKETS + 1), 0, None
        rows, signs = [], []

        def fit() -> int:
            y = np.array(signs, float)
            costs = np.where(y > 0, cost / (2 * (y > 0).mean()), cost / (2 * (y < 0).mean()))
            total[:] += len(y) * descend(rows, y, ratios.value, costs, rounds, 11)
            rows.clear()
            signs.clear()
            return len(y)

        for batch in batches:
            for at, good, block in zip(_rows(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if block != now and rows:
                    models += fit()
                now = block
                rows.append(at)
                signs.append(1 if good else -1)
        if rows:
            models += fit()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], models))], ["bucket", "w"])
    return run


class Model:
    def __init__(self, weights: np.ndarray, constant: float, slope: float, shift: float) -> None:
        self.weights, self.constant, self.slope, self.shift = weights, constant, slope, shift

    def margins(self, rows: Iterator[np.ndarray], ratios: np.ndarray) -> np.ndarray:
        out = []
        for at in rows:
            v = ratios[at]
            out.append(self.weights[at] @ v / max(np.sqrt(v @ v), 1e-9) + self.constant)
        return np.array(out)


def _curve_bins(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ratios = shared.value
        for batch in batches:
            bins = ((np.clip(model.margins(_rows(batch), ratios), -REACH, REACH) + REACH) / (2 * REACH) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "good"])
    return run


def curve(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through counts at ``x``, by Newton's method with a little weight decay."""
    p = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        gradient = design.T @ (s * (good + bad) - good) + np.array([1e-2, 0]) * p
        bend = (design * (s * (1 - s) * (good + bad))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(bend, gradient)
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ratios = shared.value
        for batch in batches:
            margin = model.margins(indicators(batch.column(0)), ratios)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30))))],
                                             ["doc_id", "held_out", "score"])
    return run


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, block_rows: int = 4000, cost: float = 10.0,
            rounds: int = 15, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; learns from ``labels`` (doc_id, quality) outside fold 0.

    Up to ``broadcast_rows`` labels (counted first; 9 bytes each) go to the texts; more are joined by shuffle, with the same rows.
    """
    context = documents.sparkSession.sparkContext
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") > 0).alias("good"))
    marks = marks.filter(fold("doc_id", FOLDS) != HELD_OUT)
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    examples = (documents.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull())
                .select("doc_id", F.col("text").cast("string").alias("text"))
                .join(marks, "doc_id")
                .select("text", "good", (fold("doc_id", FOLDS) == CURVE_FOLD).alias("curve"),
                        F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text").alias("key"), F.monotonically_increasing_id().alias("row")))
    stored = cut_lineage(in_arrow(examples, _features, "at BINARY, good BOOLEAN, curve BOOLEAN, key BIGINT, row BIGINT"))
    learn = stored.filter("NOT curve")
    counts = learn.select("at", "good").mapInArrow(_counts, "good INT, bucket INT, n BIGINT").groupBy("good", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2, BUCKETS + 1))
    table[counts["good"], counts["bucket"] + 1] = counts["n"]
    docs = table[:, 0]
    smooth = (table[:, 1:] + 1) / (docs[:, None] + 2)
    ratios = np.where(table[:, 1:].sum(0) > 0, np.log(smooth[1]) - np.log(smooth[0]), 0.0)
    if docs.min() > 0:
        dealt = deal(learn, docs.astype(np.int64), block_rows)
        dealt = F.broadcast(dealt) if docs.sum() <= broadcast_rows / 2 else dealt
        tasks = int(min(max(1, docs.sum() // block_rows), FIT_TASKS))
        parts = (learn.select("row", "at", "good").join(dealt, "row").repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int"))
                 .sortWithinPartitions("block", "slot", "good").select("at", "good", "block"))
        fitted = (parts.mapInArrow(_fit(context.broadcast(ratios), cost, rounds), "bucket INT, w DOUBLE")
                  .groupBy("bucket").agg(F.sum("w").alias("w")).toPandas())
        weights = np.zeros(BUCKETS + 2)  # the last, at -1, is the number of rows fitted on
        weights[fitted["bucket"]] = fitted["w"]
        weights = weights[:-1] / max(weights[-1], 1.0)
        model = Model(weights[:-1], float(weights[-1]), 1.0, 0.0)
        held = stored.filter("curve").select("at", "good")
        seen = held.mapInArrow(_curve_bins(context.broadcast((model, ratios))), "bin INT, good BOOLEAN").groupBy("bin", "good").count().toPandas()
        if seen["good"].nunique() == 2:
            x = (np.arange(BINS + 1) + 0.5) / BINS * 2 * REACH - REACH
            by = np.zeros((2, BINS + 1))
            by[seen["good"].astype(int), seen["bin"]] = seen["count"]
            model.slope, model.shift = curve(x, by[1], by[0])
    else:
        share = (docs[1] + 0.5 * (docs.sum() == 0)) / max(docs.sum(), 1.0)
        share = min(max(share, 1e-6), 1 - 1e-6)
        model = Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = documents.select(F.col("text").cast("string").alias("text"), "doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = in_arrow(rows, _score(context.broadcast((model, ratios))), f"doc_id {kind}, held_out BOOLEAN, score DOUBLE")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
