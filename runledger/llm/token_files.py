"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` sorts documents by id into ranges, one file each, and encodes inside the sorted ranges, so only texts are
moved.  ``read_tokens`` reads stripes in parallel; a filter on doc_id prunes stripes and row groups by statistics and
filters.  A batch of texts is cut into pieces at white space all at once; each different piece is looked up in a bounded table
or encoded by the tokenizers library, and its ids are taken wherever it stands; the result equals encoding the whole text.

Order: ascending doc_id, null ids first, rows with equal ids by text.  A null text is empty: it has the end mark alone.  An
empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut_lineage, in_arrow

#: White space or separators of Unicode that are not ASCII white space; texts with one are encoded as a whole.
UNSAFE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F,
                                            0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")
BYTES_PER_FILE = 64 << 20
#: Bytes of a worker's table of known pieces and words, and what an entry costs besides its text and ids.
TABLE_BYTES, ENTRY_BYTES = 48 << 20, 140
END_MARKS = b".,;:!?"
LONG_PIECE = 48
#: Bytes of texts that are encoded together, and words that the library gets at once (it takes a kilobyte a word).
GROUP_BYTES, WORDS = 8 << 20, 5000
#: A byte that no text in UTF-8 has.
APART = 0xFF
COLUMNS = "doc_id BIGINT, part INT, pos BIGINT, ids ARRAY<INT>"


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian 32-bit ids. A piece never depends on what stands before its white space.

    Three tables share one bound of bytes: single words behind a space, other single words, and pieces of several words of the
    vocabulary's pattern.  Only what a batch holds more than once is kept: most different pieces are rare.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(PATTERN)
        # New words go to the same model many at once, spelled in the vocabulary's letters and apart by spaces, which are no letters.
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        if not vocabulary.keys() >= set(letters.values()):
            raise ValueError(f"{path} lacks letters of some bytes")
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        self.letters[APART] = 32
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.spaced: dict[bytes, bytes] = {}
        self.used = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, table: dict[bytes, bytes], piece: bytes, found: bytes) -> bytes:
        """Remember what a piece or word gives; a full table starts anew."""
        size = ENTRY_BYTES + len(piece) + len(found)
        if self.used + size > TABLE_BYTES:
            for full in (self.pieces, self.words, self.spaced):
                full.clear()
            self.used = 0
        self.used += size
        table[piece] = found
        return found

    def _words(self, words: list[bytes]) -> np.ndarray:
        """The ids of words as the vocabulary's pattern cuts them."""
        spelled = self.letters[np.frombuffer(bytes([APART]).join(words), np.uint8)].tobytes().decode("utf-16-le")
        return np.array(self.speller.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, pieces: list[bytes], often: list[bool]) -> list[bytes]:
        """The ids of pieces that no table has; those seen more than once are kept."""
        words, tables, out = [], [], []
        for piece in pieces:
            text, table = piece.decode(), self.spaced if piece[0] == 32 else self.words
            if (text[1:] if piece[0] == 32 else text).isalpha() and len(piece) <= LONG_PIECE:  # letters after at most one space are one word
                words.append(piece)
            elif len(piece) > LONG_PIECE or UNSAFE.search(text):
                table = None
            else:
                table = self.pieces
                words += [word.encode() for word in self.pattern.findall(text)]
            tables.append(table)
        ids = np.concatenate([np.zeros(0, "<u4"), *(self._words(words[k:k + WORDS]) for k in range(0, len(words), WORDS))])
        ends = np.cumsum([0 if table is None else len(piece) for piece, table in zip(pieces, tables)])
        cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")).tolist()
        raw, low = ids.tobytes(), 0
        for piece, table, keep, high in zip(pieces, tables, often, cuts):
            found = raw[low:high] if table is not None else self.whole(piece.decode())
            out.append(self._keep(table, piece, found) if keep and table is not None else found)
            low = high
        return out

    def batch(self, texts: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each array of texts in turn: where each text's ids begin (and the last one's end), and all ids."""
        cut = [_cut(array) for array in texts]
        firsts, counts = [places for places, _ in cut], [len(pieces) for _, pieces in cut]
        pieces = pa.concat_arrays([pa.array([], pa.binary()), *(pieces for _, pieces in cut)])
        del cut
        pieces = pieces.dictionary_encode()
        found = self._look_up(pieces)
        numbers, sizes = pieces.indices, np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
        del pieces, found
        low = 0
        for places, count in zip(firsts, counts):
            own = numbers.slice(low, count)
            ends = np.append(0, np.cumsum(sizes[own.to_numpy()]))
            yield ends[places], lists.take(own).flatten().to_numpy()
            low += count

    def _look_up(self, pieces: pa.DictionaryArray) -> list[bytes]:
        """The ids of each different piece."""
        known = pieces.dictionary
        if not len(known):
            return []
        often = np.bincount(pieces.indices.to_numpy(), minlength=len(known)) > 1
        places, raw = np.frombuffer(known.buffers()[1], np.int32)[:len(known) + 1].tolist(), known.buffers()[2].to_pybytes()
        spaced, words, several = self.spaced.get, self.words.get, self.pieces.get
        found = [spaced(piece) or words(piece) or several(piece) for piece in map(raw.__getitem__, map(slice, places, places[1:]))]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._new([raw[places[k]:places[k + 1]] for k in new], often[new].tolist())):
            found[k] = ids
        return found

    def __call__(self, text: str) -> bytes:
        (_, ids), = self.batch([pa.array([text], pa.string())])
        return ids.astype("<u4").tobytes()


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each text's first piece (and how many there are in all), and the pieces."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, places = places[0], places - places[0]
    if not places[-1]:
        return places, pa.array([], pa.binary())
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:low + places[-1]]
    begins = _begins(raw)
    for k in np.flatnonzero(pc.match_substring_regex(texts, UNSAFE.pattern).to_numpy(zero_copy_only=False)):
        begins[places[k]:places[k + 1]] = False
    begins[places[:-1][np.diff(places) > 0]] = True
    cuts = np.append(np.flatnonzero(begins).astype(np.int32), np.int32(len(raw)))
    pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
    return np.searchsorted(cuts, places), pieces


def _begins(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece: white space behind anything else, end marks behind a letter, and a letter behind a lone line end."""
    blank = (raw == 32) | (raw - 9 < 5)
    letter = (raw | 32) - 97 < 26
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[1:] |= np.logical_or.reduce([raw[1:] == mark for mark in END_MARKS]) & letter[:-1]
    begins[2:] |= letter[2:] & (raw[1:-1] == 10) & ~blank[:-2]
    return begins


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The process's encoder: a worker keeps its tables from task to task."""
    return Encoder(path)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that are encoded together: the larger a group, the fewer pieces it holds only once."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(1).nbytes
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, pos = encoder(path), TaskContext.get().partitionId(), 0
        for group in _groups(batches):
            for batch, (places, ids) in zip(group, encode.batch([batch.column(1) for batch in group])):
                rows = batch.num_rows
                values = np.insert(ids, places[1:], np.int32(end))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(pos, pos + rows)),
                     pa.ListArray.from_arrays(pa.array((places + np.arange(rows + 1)).astype(np.int32)), pa.array(values))],
                    ["doc_id", "part", "pos", "ids"])
                pos += rows
        pa.default_memory_pool().release_unused()  # the worker waits for other stages' tasks
    return run


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end: int = 0, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write doc_id, part, pos, ids (with ``end`` after each document) in ascending doc_id order; a part is one file."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    files = max(2 * cores, -(-size // bytes_per_file))
    ordered = rows.repartitionByRange(int(files), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (in_arrow(ordered, _encode(vocabulary, end), COLUMNS).write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        lists = batch.column(3)
        places, raw = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        checks = [zlib.crc32(raw[a:b]) for a, b in zip(places[:-1], places[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(places).astype(np.int64)), pa.array(np.array(checks, np.int64))],
            ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def manifest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in token files.

    A part's rows are numbered by ``pos``, so running sums stay inside a part; the parts' totals shift them.
    """
    rows = cut_lineage(in_arrow(
        tokens.select("doc_id", "part", "pos", "ids"), _digest, "doc_id BIGINT, part INT, pos BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (rows.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
             .withColumn("_shift", F.coalesce(F.sum("_all").over(before), F.lit(0))).select("part", "_shift"))
    return (rows.withColumn("_end", F.sum("n_tokens").over(inside)).join(shift, "part")
            .select("doc_id", (F.col("_shift") + F.col("_end") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"))
