"""A stored trigram index over texts, so that a search reads only texts that can match.

Texts are numbered; the index holds for each three-letter piece of the lower-case texts the numbers of the texts it is in, in ascending
lists of at most ``LIST`` numbers, sorted by piece, so that a look-up reads few row groups.  A search intersects the lists of the pieces
its words must have, and looks for the words themselves only in the texts that are left.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from re import IGNORECASE, error
from re._constants import LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN
from re._parser import parse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, in_arrow
from .catalog import search_content

#: Numbers in a list at most; letters sorted at once.
LIST, STRETCH = 4096, 1 << 20
LISTS = "piece string, text_ids array<bigint>"


def folded(text: Column) -> Column:
    """Lower case, with the two letters whose upper case is another letter's made that letter."""
    return F.translate(F.lower(text), "\u017f\u0307", "s")


def _listed(ids: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """For each piece of some texts the numbers of the texts it is in, by sorting (piece, text) as one whole number."""
    order = np.argsort(ids)
    ids, texts = ids[order], [texts[k] for k in order]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    place = np.zeros(sys.maxunicode + 1, np.int64)
    place[letters] = 1
    known = np.flatnonzero(place)
    base = len(known)
    if base ** 3 * len(texts) >> 63:     # never so for one text: there are fewer than 2^21 letters
        half = len(texts) // 2
        yield from _listed(ids[:half], texts[:half])
        yield from _listed(ids[half:], texts[half:])
        return
    place[known] = np.arange(base)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = []
    for start in range(0, len(letters) - 2, STRETCH):
        code, own = place[letters[start:start + STRETCH + 2]], owner[start:start + STRETCH + 2]
        whole = own[:-2] == own[2:]
        found.append(_distinct((((code[:-2] * base + code[1:-1]) * base + code[2:]) * len(texts) + own[:-2])[whole]))
    if not found or not sum(map(len, found)):
        return
    keys = _distinct(np.concatenate(found)) if len(found) > 1 else found[0]
    piece, text = np.divmod(keys, len(texts))
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    codes = piece[starts]
    spelled = known[np.stack([codes // base ** 2, codes // base % base, codes % base], 1)].astype(np.uint32)
    width = (1 + (spelled > 0x7F) + (spelled > 0x7FF).astype(int) + (spelled > 0xFFFF)).sum(1)
    names = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, np.cumsum(width)].astype(np.int32)),
                                        pa.py_buffer(spelled.tobytes().decode("utf-32-le").encode()))
    yield _rows(names, np.r_[starts, len(keys)], pa.array(ids[text]))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _rows(pieces: pa.Array, borders: np.ndarray, text_ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pieces, pa.ListArray.from_arrays(pa.array(borders, pa.int32()), text_ids)], ["piece", "text_ids"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _listed(batch.column(0).to_numpy(), [str(t, errors="replace") for t in batch.column(1).cast(pa.binary()).to_pylist()])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists of the same piece that follow each other as lists of ``LIST`` numbers and a rest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, lists = batch.column(0), batch.column(1)
        first = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        begin, end = offsets[first], np.r_[offsets[first[1:]], offsets[-1]]
        cuts = -(-(end - begin) // LIST)
        inside = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        ids = lists.flatten().to_numpy()
        rising = ids[1:] > ids[:-1]
        rising[begin[1:] - 1] = True
        if not rising.all():     # a batch of texts was read from several places
            ids = ids[np.lexsort((ids, np.repeat(first, end - begin)))]
        yield _rows(names.take(pa.array(np.repeat(first, cuts))), np.r_[np.repeat(begin, cuts) + inside * LIST, offsets[-1]], pa.array(ids))


def build_index(texts: DataFrame, path: str) -> None:
    """Store texts (path, name, content and what else they have) and their index below ``path``.

    Each batch of texts becomes one list a piece before anything is shuffled, so a piece's text costs a number and no row.  These lists are
    stored, because finding the borders of the ranges reads them once more.
    """
    texts.withColumn("text_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/texts")
    stored = texts.sparkSession.read.parquet(f"{path}/texts").filter("content IS NOT NULL")
    found = cut_lineage(in_arrow(stored.select("text_id", folded(F.col("content"))), _pieces, LISTS))
    ranged = found.withColumn("first", F.col("text_ids")[0]).repartitionByRange("piece", "first").sortWithinPartitions("piece", "first")
    in_arrow(ranged.drop("first"), _joined, LISTS).write.mode("overwrite").parquet(f"{path}/pieces")


def literals(pattern: str) -> list[str]:
    """Runs of letters that every match of a regular expression must have; none where that can't be told."""
    try:
        parsed = parse(pattern)
    except (error, OverflowError):
        return []
    if parsed.state.flags & IGNORECASE:
        return []
    runs: list[str] = [""]

    def walk(items) -> None:
        for kind, value in items:
            if kind is LITERAL:
                runs[-1] += chr(value)
            elif kind is SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            else:
                runs.append("")
                if kind in (MAX_REPEAT, MIN_REPEAT) and value[0] > 0:
                    walk(value[2])
                    runs.append("")

    walk(parsed)
    return [r for r in runs if len(r) > 2]


def candidates(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The stored texts that have all pieces of all words; all texts where no word has three letters."""
    stored = spark.read.parquet(f"{path}/texts")
    lowered = [w.lower().replace("\u017f", "s").replace("\u0307", "") for w in words]
    wanted = sorted({w[i:i + 3] for w in lowered for i in range(len(w) - 2)})
    if not wanted:
        return stored
    listed = spark.read.parquet(f"{path}/pieces").filter(F.col("piece").isin(wanted))
    hits = listed.select("piece", F.explode("text_ids").alias("text_id")).groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    return stored.join(hits, "text_id", "left_semi")


def search_index(spark: SparkSession, path: str, query: str, is_regex: bool = False, **options) -> DataFrame:
    """What :func:`runledger.operators.catalog.search_content` finds, reading only texts that the index leaves."""
    return search_content(candidates(spark, path, literals(query) if is_regex else [query]).drop("text_id"), query, is_regex=is_regex, **options)
