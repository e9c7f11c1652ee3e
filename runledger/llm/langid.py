"""Language ID by error-correcting output codes over byte n-grams.

Each learned language has a codeword of +1/-1 bits; each bit has a binary n-gram classifier (log-odds of the pooled n-gram
shares of the languages on either side, centred and scaled so that a language's mean is at least one away from zero).
Decoding takes the codeword with the smallest loss, where a bit counts for a language as far as it was right on that
language's training documents.  A text whose two best codewords are close, or that has few n-grams, is flagged ambiguous.

Counting and weighing cover all training rows in two scans, and all their languages.  The counts are a stored table, from which
tasks sum the shares per bucket and bit, and the means per language and bit.  The driver holds buckets x bits and languages x
bits numbers; there are about ten bits for each doubling of the languages.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no language is learned.  Rows with a null
lang or id are not learned from.  Texts are read whole; repeated rows each count; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pyspark.sql.types import StructType

from .common import cut_lineage, in_arrow
from .textblocks import blocks

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
#: ASCII letters and all bytes of other letters stay; the rest is one separator.
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def grams(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the n-grams of a block, order by order; none crosses a row or starts with two separators."""
    letters = LETTERS[data]
    ends = np.repeat(rows[1:], np.diff(rows))
    wanted = np.ones(len(data), bool)
    wanted[:-1] = ~((letters[:-1] == 32) & (letters[1:] == 32))
    for n in ORDERS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ letters[k:k + size]
        code *= np.uint32(0x9E3779B1)
        start = np.flatnonzero(wanted[:size] & (np.arange(n, n + size) <= ends[:size]))
        yield start, (code[start] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) with the task's n-gram counts; bucket -1 counts documents."""
    totals: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(total[at])],
                                             ["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for low, high, rows, data in blocks(batch.column(0)):
            used, local = np.unique(codes[low:high], return_inverse=True)
            if len(used) > 64:  # too many for arrays: only what is there
                owner = np.repeat(local, np.diff(rows))
                keys = [np.unique(owner[start] * BUCKETS + bucket, return_counts=True) for start, bucket in grams(data, rows)]
                docs = np.bincount(local)
                at = np.concatenate([np.arange(len(used)), *(k // BUCKETS for k, _ in keys)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(used[at])), pa.array(np.concatenate([np.full(len(used), -1), *(k % BUCKETS for k, _ in keys)]).astype(np.int32)),
                     pa.array(np.concatenate([docs, *(n for _, n in keys)]).astype(np.int64))], ["lang", "bucket", "n"])
                continue
            flat = np.zeros(len(used) * BUCKETS, np.int64)
            owner = np.repeat(local, np.diff(rows))
            for start, bucket in grams(data, rows):
                flat += np.bincount(owner[start] * BUCKETS + bucket, minlength=len(flat))
            for k, code in enumerate(used):
                total = totals.setdefault(names[code], np.zeros(BUCKETS + 1, np.int64))
                total[0] += int((local == k).sum())
                total[1:] += flat[k * BUCKETS:(k + 1) * BUCKETS]
            if len(totals) > 64:
                yield from flush()
    yield from flush()


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """languages x bits of +1/-1, rows far apart: all splits for up to five languages, else the best of seeded draws.

    Of more than 500 languages not all pairs are compared; one draw's rows are apart by chance, as bits grow with the languages.
    """
    if languages <= 5:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(languages - 1)] for s in range(2 ** max(languages - 1, 0) - 1)]
        return np.array(splits, np.int8).reshape(len(splits), max(languages, 0)).T
    draw, best, width = np.random.default_rng(seed), None, math.ceil(10 * math.log2(languages))
    for _ in range(60 if languages <= 500 else 1):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, width))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < languages]
        if languages > 500:
            return code
        apart = ((code.shape[1] - (code.astype(int) @ code.T.astype(int))) // 2 + np.eye(languages, dtype=int) * width).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Languages, their codewords, one weight per bucket and bit, and how far each bit counts for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, code: np.ndarray) -> None:
        self.languages, self.code, self.weights = languages, code, weights
        self.centre, self.scale = np.zeros(code.shape[1]), np.ones(code.shape[1])
        self.trust = np.ones_like(self.code, float)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scaled margin of each text and bit, and each text's number of n-grams."""
        sums, sizes = np.zeros((len(column), self.code.shape[1])), np.zeros(len(column), np.int64)
        for low, high, rows, data in blocks(column, max(1 << 16, (1 << 21) // max(self.code.shape[1], 8))):
            owner = np.repeat(np.arange(high - low), np.diff(rows))
            for start, bucket in grams(data, rows):
                if len(start):
                    first = np.flatnonzero(np.diff(owner[start], prepend=-1))
                    sums[low + owner[start][first]] += np.add.reduceat(self.weights[bucket], first, 0, dtype=np.float64)
                    sizes[low:high] += np.bincount(owner[start], minlength=high - low)
        return (sums / np.maximum(sizes, 1)[:, None] - self.centre) / self.scale, sizes

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Weighted mean loss of each text against each codeword."""
        wrong = np.exp(np.clip(margins, -3, 3))
        loss = (1 / wrong) @ (self.trust * (self.code > 0)).T + wrong @ (self.trust * (self.code < 0)).T
        return loss / self.trust.sum(1)


def _sides(shared, totals):
    """Sums of the shares of the languages on the + side of each bit and on either side; all rows of a bucket are in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, own = shared.value, totals.value
        sums = np.zeros((BUCKETS, code.shape[1] + 1))
        for batch in batches:
            lang, bucket, n = (c.to_numpy() for c in batch.columns)
            share = n / (own[lang] + 0.5 * BUCKETS)
            for low in range(0, len(lang), 4096):
                k = slice(low, low + 4096)
                np.add.at(sums, bucket[k], np.concatenate([(code[lang[k]] > 0) * share[k, None], share[k, None]], 1))
        at = np.flatnonzero(sums[:, -1])
        flat = pa.array(sums[at].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * sums.shape[1]).astype(np.int32)), flat)],
                                         ["bucket", "sums"])
    return run


def _edges(shared, totals):
    """Per bit, the least mean on the + side and the largest on the other; all rows of a language are in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, weights = shared.value
        own, means = totals.value, {}
        base = 0.5 * weights.sum(0, dtype=np.float64)
        for batch in batches:
            lang, bucket, n = (c.to_numpy() for c in batch.columns)
            order = np.argsort(lang, kind="stable")
            lang, bucket, n = lang[order], bucket[order], n[order]
            first = np.flatnonzero(np.diff(lang, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lang)]):
                means[lang[a]] = means.get(lang[a], base) + n[a:b] @ weights[bucket[a:b]].astype(np.float64)
        for x, mean in means.items():
            means[x] = mean / (own[x] + 0.5 * BUCKETS)
        if means:
            mean, side = np.array(list(means.values())), code[list(means)] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(code.shape[1], dtype=np.int32)), pa.array(np.where(side, mean, np.inf).min(0)),
                                              pa.array(np.where(side, -np.inf, mean).max(0))], ["bit", "high", "low"])
    return run


def _right(model):
    """Per task: how often each bit was right for the documents of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        place, right = {x: i for i, x in enumerate(m.languages)}, np.zeros(m.code.shape, np.int64)
        for batch in batches:
            margins, _ = m.margins(batch.column(0))
            lang = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            good = (np.sign(margins) == m.code[lang]) & (lang >= 0)[:, None]
            np.add.at(right, lang[lang >= 0], good[lang >= 0])
        rows, bits = np.nonzero(right)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(bits.astype(np.int32)), pa.array(right[rows, bits])],
                                         ["lang", "bit", "n"])
    return run


def _predict(model, near: float, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            step = max(1, (1 << 22) // len(m.languages))
            for batch in (whole.slice(low, step) for low in range(0, len(whole), step)):
                margins, sizes = m.margins(batch.column(0))
                loss = m.decode(margins)
                share = np.exp(-3 * (loss - loss.min(1, keepdims=True)))
                every = np.arange(len(loss))
                best = loss.argmin(1)
                score, least = share[every, best] / share.sum(1), loss[every, best]
                loss[every, best] = np.inf
                gap = loss.min(1) - least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m.languages[i] for i in best], pa.string()), pa.array(score), pa.array((gap < near) | (sizes < few)), *batch.columns[1:]],
                    ["lang_pred", "score", "ambiguous", *batch.schema.names[1:]])
    return run


def _text() -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(" "))


def _numbered(place):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([known[x] for x in batch.column(0).to_pylist()], pa.int32()), *batch.columns[1:]], ["lang", "bucket", "n"])
    return run


def fit(examples: DataFrame) -> Model | None:
    """Learn from rows (text, lang); rows without text or lang are left out. None if there is nothing to learn."""
    rows = examples.filter("text IS NOT NULL AND lang IS NOT NULL").select(_text().alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = cut_lineage(in_arrow(rows, _counts, "lang STRING, bucket INT, n BIGINT").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    docs = {r["lang"]: r["n"] for r in counts.filter("bucket = -1").collect()}
    languages = sorted(docs)
    if not languages:
        return None
    send = examples.sparkSession.sparkContext.broadcast
    code = codewords(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    model = Model(languages, np.zeros((BUCKETS, code.shape[1]), np.float32), code)
    if code.shape[1]:
        own = np.zeros(len(languages))
        for r in counts.filter("bucket >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect():
            own[place[r["lang"]]] = r["n"]
        totals, found = send(own), counts.filter("bucket >= 0").mapInArrow(_numbered(send(place)), "lang INT, bucket INT, n BIGINT")
        none, plus = 0.5 / (own + 0.5 * BUCKETS), code > 0
        sums = np.zeros((BUCKETS, code.shape[1] + 1))
        sides = found.repartition("bucket").mapInArrow(_sides(send(code), totals), "bucket INT, sums ARRAY<DOUBLE>").toPandas()
        if len(sides):
            sums[sides["bucket"]] = np.stack(sides["sums"])
        above, every = sums[:, :-1] + none @ plus, sums[:, -1:] + none.sum()
        model.weights[:] = np.log(above / plus.sum(0)) - np.log((every - above) / (~plus).sum(0))
        edges = found.repartition("lang").mapInArrow(_edges(send((code, model.weights)), totals), "bit INT, high DOUBLE, low DOUBLE")
        # a language without n-grams has the mean of the shares that all buckets get
        blank, base = own == 0, 0.5 * model.weights.sum(0, dtype=np.float64) / (0.5 * BUCKETS)
        high, low = np.where(plus[blank].any(0), base, np.inf), np.where((~plus[blank]).any(0), base, -np.inf)
        for r in edges.groupBy("bit").agg(F.min("high").alias("high"), F.max("low").alias("low")).collect():
            high[r["bit"]], low[r["bit"]] = min(high[r["bit"]], r["high"]), max(low[r["bit"]], r["low"])
        model.centre, model.scale = (high + low) / 2, np.maximum((high - low) / 2, 1e-6)
        right = np.zeros(code.shape)
        for r in in_arrow(rows, _right(send(model)), "lang INT, bit INT, n BIGINT").groupBy("lang", "bit").agg(F.sum("n").alias("n")).collect():
            right[r["lang"], r["bit"]] = r["n"]
        model.trust = np.maximum(right / np.array([docs[x] for x in languages])[:, None], 0.01)
    return model


def predict(documents: DataFrame, model: Model | None, keep: list[Column], near: float = 0.25, few: int = 12) -> DataFrame:
    """lang_pred, score, ambiguous and the ``keep`` columns for each row; ``near``: loss gap, ``few``: n-grams."""
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(_text().alias("text"), F.struct(*keep).alias("_kept"), lettered.alias("_lettered"))
    if model is None:
        named = rows.select(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"), "_kept", "_lettered")
    else:
        shared = documents.sparkSession.sparkContext.broadcast(model)
        out = StructType.fromDDL("lang_pred STRING, score DOUBLE, ambiguous BOOLEAN")
        out = StructType([*out, rows.schema["_kept"], rows.schema["_lettered"]])
        named = in_arrow(rows.select("text", "_kept", "_lettered"), _predict(shared, near, few), out)
    return named.select(F.when(F.col("_lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                        F.when(F.col("_lettered"), F.col("score")).otherwise(0.0).alias("score"), "ambiguous", "_kept.*")


def accepted(documents: DataFrame, model: Model | None, unsure: float = 0.4) -> DataFrame:
    """The documents, all columns, without those that have no letter or are ambiguous with a score below ``unsure``.

    Without a model only texts without a letter are rejected.
    """
    named = predict(documents, model, [F.struct("*").alias("_row")])
    doubtful = F.col("ambiguous") & (F.col("score") < unsure) if model is not None else F.lit(False)
    lettered = F.coalesce(F.col("_row.text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return named.filter(lettered & ~doubtful).select("_row.*")
