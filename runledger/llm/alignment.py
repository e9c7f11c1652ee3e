"""Alignment of two tokenizers' tokens over the same bytes, and how often token pairs are linked in a corpus.

Tokens of A and B are cut into groups at the byte offsets where both end; all A-B pairs of a group are linked.

* A fragment is what a byte range contributes: the tokens that end in it, as an open prefix (up to its first common end), closed
  groups, and an open suffix (behind its last common end).  :func:`compose` joins neighbouring fragments; it is associative and
  :data:`EMPTY` is its identity, so fragments can be reduced in any tree.
* Documents up to ``chunk_bytes`` are one fragment each, taken in blocks of many documents at once.  Longer ones are cut into byte
  ranges that are dealt to tasks.  A range is tokenized with the text up to the next places where neither tokenizer can have a
  token across (a space behind a printable ASCII character), so its own borders may lie inside words and groups; the fragments
  are reduced by rounds of ``FAN_IN`` neighbours.  A stretch without such places stays in one range.
* A document names its pairs by places in its block's list of distinct pairs.  Counts are documents per pair, summed from the
  blocks' lists; each block then gets the counts of its own pairs only, so nothing that grows with the corpus is broadcast.

Texts that are null or empty, or whose tokens of A or B do not give back a space and the text, have no tokens: zeros and ''.
Null and repeated ids are rows like others, an empty table gives an empty one, columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, in_arrow, scratch_path, spread

CHUNK_BYTES, BLOCK_BYTES, BLOCK_ROWS = 1 << 16, 1 << 20, 4096
FAN_IN = 8
#: Groups with more links than this are counted by distinct ids instead of link by link.
MANY_LINKS = 1 << 12
ID_BITS = 20
#: Characters that every Unicode version classes alike; texts with others go to the tokenizers library itself.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧‰-⁞]")

BLOCKS, PAIRS, CHUNKS = 0, 1, 2
STORED = ("block BIGINT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, groups_sha256 STRING, groups BINARY, "
          "places ARRAY<INT>, times ARRAY<BIGINT>, place INT, pair BIGINT, docs BIGINT, pos BIGINT, low BIGINT, high BIGINT, body BINARY, "
          "kind INT")
FRAGMENT = ("block BIGINT, doc_id BIGINT, pos BIGINT, valid BOOLEAN, cut BOOLEAN, pre_a ARRAY<INT>, pre_b ARRAY<INT>, suf_a ARRAY<INT>, "
            "suf_b ARRAY<INT>, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, text BINARY, keys ARRAY<BIGINT>, times ARRAY<BIGINT>")
SCORED = ("doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_best BIGINT, count_sum BIGINT, groups_sha256 STRING, "
          "groups BINARY")
NONE = np.zeros(0, np.int64)
_KINDS = {"BIGINT": pa.int64(), "INT": pa.int32(), "STRING": pa.string(), "BINARY": pa.binary(), "BOOLEAN": pa.bool_(),
          "ARRAY<INT>": pa.list_(pa.int32()), "ARRAY<BIGINT>": pa.list_(pa.int64())}
STORED_ARROW, FRAGMENT_ARROW = (pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, ddl.split(", "))]) for ddl in (STORED, FRAGMENT))


# --- the two tokenizers ---------------------------------------------------------------------------------------------------


class Tokenizers:
    """A: byte-level BPE of a tokenizers file. B: BPE pieces of a sentencepiece model, which adds the leading space itself."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        from .token_files import byte_letters

        self.path = a
        with open(a, encoding="utf-8") as file:
            content = json.load(file)
        added = {t["content"] for t in content["added_tokens"]}
        letters = {letter: byte for byte, letter in byte_letters().items()}
        entries = {i: bytes(letters[c] for c in token) for token, i in content["model"]["vocab"].items() if token not in added}
        # Ids of such a vocabulary follow its merges, so the lowest id of a merged pair is the next merge.
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={v: k for k, v in entries.items()}, special_tokens={})
        self.slow = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> np.ndarray:
        if not ODD.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of A and of B for each text, which begins with a space, and whether both give back its bytes."""
        for text, b in zip(texts, self.pieces.encode([t[1:] for t in texts], num_threads=1)):
            whole, a = text.encode(), self.ids_a(text)
            same = (b"".join(map(self.bytes_b.__getitem__, b)) == whole and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole)
            yield a, np.array(b, np.int64), same


@lru_cache(1)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


# --- groups, links and their text -----------------------------------------------------------------------------------------


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and the B tokens that end a group: ascending end offsets that both have."""
    if not len(ends_a) or not len(ends_b):
        return NONE, NONE
    place = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    last_a = np.flatnonzero(ends_b[place] == ends_a)
    return last_a, place[last_a]


def tally(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    if not len(keys):
        return NONE, NONE
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def links(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner << 40 | A id << 20 | B id) and how often, distinct and ascending, of all groups; ``owner`` is one number a group."""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    start_a, start_b, size = last_a + 1 - n_a, last_b + 1 - n_b, n_a * n_b
    many = np.flatnonzero(size > MANY_LINKS)
    few = np.where(size > MANY_LINKS, 0, size)
    group = np.repeat(np.arange(len(few)), few)
    k = np.arange(len(group)) - np.repeat(np.cumsum(few) - few, few)
    width = n_b[group]
    keys = (owner[group] << 2 * ID_BITS) | (a[start_a[group] + k // np.maximum(width, 1)] << ID_BITS) | b[start_b[group] + k % np.maximum(width, 1)]
    all_keys, all_times = [keys], [np.ones(len(keys), np.int64)]
    for g in many:
        ids_a, times_a = np.unique(a[start_a[g]:last_a[g] + 1], return_counts=True)
        ids_b, times_b = np.unique(b[start_b[g]:last_b[g] + 1], return_counts=True)
        all_keys.append(((owner[g] << 2 * ID_BITS) | (ids_a[:, None] << ID_BITS) | ids_b[None, :]).ravel())
        all_times.append((times_a[:, None] * times_b[None, :]).ravel())
    return tally(np.concatenate(all_keys), np.concatenate(all_times))


def spell(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and the end of each group in it; every group ends with a semicolon."""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    before_b = np.concatenate([[0], last_b + 1])[:-1] if len(last_b) else NONE
    slot_a = np.arange(len(a)) + before_b[group_a]
    slot_b = np.arange(len(b)) + (last_a + 1)[group_b]
    ids[slot_a], ids[slot_b] = a, b
    mark[slot_a[last_a]], mark[slot_b[last_b]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    for k in range(1, 7):
        digits += ids >= 10 ** k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    rest, at, left = ids, ends - 2, digits
    while len(rest):
        out[at] = 48 + rest % 10
        more = left > 1
        rest, at, left = rest[more] // 10, at[more] - 1, left[more] - 1
    return out, ends[slot_b[last_b]]


# --- fragments ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fragment:
    """A byte range's tokens. Without a common end (``cut`` false) all its tokens are the prefix. ``text`` and ``n_`` are of closed groups."""

    valid: bool = True
    cut: bool = False
    pre_a: np.ndarray = field(default_factory=lambda: NONE)
    pre_b: np.ndarray = field(default_factory=lambda: NONE)
    suf_a: np.ndarray = field(default_factory=lambda: NONE)
    suf_b: np.ndarray = field(default_factory=lambda: NONE)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    text: bytes = b""
    keys: np.ndarray = field(default_factory=lambda: NONE)
    times: np.ndarray = field(default_factory=lambda: NONE)


EMPTY = Fragment()


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of tokens whose ends lie in one byte range."""
    last_a, last_b = group_ends(ends_a, ends_b)
    if not len(last_a):
        return Fragment(pre_a=a, pre_b=b)
    first_a, first_b, end_a, end_b = last_a[0] + 1, last_b[0] + 1, last_a[-1] + 1, last_b[-1] + 1
    inner = _closed(a[first_a:end_a], b[first_b:end_b], last_a[1:] - first_a, last_b[1:] - first_b)
    return replace(inner, pre_a=a[:first_a], pre_b=b[:first_b], suf_a=a[end_a:], suf_b=b[end_b:])


def _closed(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> Fragment:
    keys, times = links(a, b, last_a, last_b, np.zeros(len(last_a), np.int64))
    return Fragment(cut=True, n_a=len(a), n_b=len(b), n_groups=len(last_a), n_links=int(times.sum()), text=spell(a, b, last_a, last_b)[0].tobytes(),
                    keys=keys, times=times)


def _sum(parts: list[Fragment]) -> dict:
    """The closed groups of neighbouring fragments as one's."""
    keys, times = tally(np.concatenate([p.keys for p in parts]), np.concatenate([p.times for p in parts]))
    return {"n_a": sum(p.n_a for p in parts), "n_b": sum(p.n_b for p in parts), "n_groups": sum(p.n_groups for p in parts),
            "n_links": sum(p.n_links for p in parts), "text": b"".join(p.text for p in parts), "keys": keys, "times": times}


def _group(a: np.ndarray, b: np.ndarray) -> Fragment:
    """One closed group."""
    return _closed(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges."""
    valid = x.valid and y.valid
    if not x.cut:
        return replace(y, valid=valid, pre_a=np.concatenate([x.pre_a, y.pre_a]), pre_b=np.concatenate([x.pre_b, y.pre_b]))
    if not y.cut:
        return replace(x, valid=valid, suf_a=np.concatenate([x.suf_a, y.pre_a]), suf_b=np.concatenate([x.suf_b, y.pre_b]))
    middle = _group(np.concatenate([x.suf_a, y.pre_a]), np.concatenate([x.suf_b, y.pre_b]))
    return Fragment(valid, True, x.pre_a, x.pre_b, y.suf_a, y.suf_b, **_sum([x, middle, y]))


def complete(x: Fragment) -> Fragment:
    """The fragment of a whole document with its prefix as its first group; void if its tokens do not give back the text."""
    if not x.valid or not x.cut:
        return EMPTY
    assert not len(x.suf_a) and not len(x.suf_b)
    return Fragment(True, True, **_sum([_group(x.pre_a, x.pre_b), x]))


# --- short documents, a block at a time -----------------------------------------------------------------------------------


def _lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values).cast(kind))


def _table(n: int, schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    made = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns
            else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)


def _rows(block: int, ids: list, n_a, n_b, n_groups, n_links, texts: list[bytes], owner: np.ndarray, pair: np.ndarray, times: np.ndarray,
          keep: bool) -> Iterator[pa.RecordBatch]:
    """The stored rows of a block: one a document, whose pairs are places in the block's list, and one a listed pair."""
    schema = STORED_ARROW
    listed, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
    borders = np.searchsorted(owner, np.arange(len(ids) + 1))
    yield _table(len(ids), schema, block=np.full(len(ids), block), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links,
                 groups_sha256=[hashlib.sha256(t).hexdigest() if t else "" for t in texts], places=_lists(place, borders, pa.int32()),
                 times=_lists(times, borders, pa.int64()), kind=np.full(len(ids), BLOCKS), **({"groups": texts} if keep else {}))
    if len(listed):
        yield _table(len(listed), schema, block=np.full(len(listed), block), place=np.arange(len(listed)), pair=listed, docs=docs,
                     kind=np.full(len(listed), PAIRS))


def _block(pair: Tokenizers, block: int, ids: list, texts: list[str], keep: bool) -> Iterator[pa.RecordBatch]:
    """Align whole documents at once: their borders are common ends, so no group crosses them."""
    rows = [(a, b) if same else (NONE, NONE) for a, b, same in pair([" " + t for t in texts])]
    rows = [r if t else (NONE, NONE) for r, t in zip(rows, texts)]
    a, b = (np.concatenate([r[k] for r in rows] or [NONE]) for k in (0, 1))
    last_a, last_b = group_ends(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
    n_a, n_b = (np.array([len(r[k]) for r in rows], np.int64) for k in (0, 1))
    groups = np.searchsorted(last_a, np.cumsum(n_a) - 1, "right")
    n_groups = np.diff(groups, prepend=0)
    owner = np.repeat(np.arange(len(rows)), n_groups)
    keys, times = links(a, b, last_a, last_b, owner)
    out, ends = spell(a, b, last_a, last_b)
    ends = np.concatenate([[0], ends])[np.concatenate([[0], groups])]
    spelled = [out[x:y - 1].tobytes() if y > x else b"" for x, y in zip(ends[:-1], ends[1:])]
    per_link, at = np.concatenate([[0], np.cumsum(times)]), np.searchsorted(keys >> 2 * ID_BITS, np.arange(len(rows) + 1))
    yield from _rows(block, ids, n_a, n_b, n_groups, np.diff(per_link[at]), spelled, keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), times, keep)


# --- long documents -------------------------------------------------------------------------------------------------------


def ranges(body: np.ndarray, chunk_bytes: int) -> list[tuple[int, int, int, int]]:
    """(low, high, from, to) of the byte ranges of a text that begins with a space: tokens ending in (low, high] are the range's,
    and tokenizing bytes from..to gives them.  A border needs places that no token crosses within a chunk on both of its sides."""
    n = len(body)
    safe = np.flatnonzero((body[1:-1] == 32) & (body[:-2] > 32) & (body[:-2] < 127)) + 1
    safe = np.concatenate([[0], safe, [n]])
    borders = [0]
    for border in range(chunk_bytes, n - chunk_bytes // 2, chunk_bytes):
        k = int(np.searchsorted(safe, border, "right"))
        if border - safe[k - 1] <= chunk_bytes and safe[min(k, len(safe) - 1)] - border <= chunk_bytes:
            borders.append(border)
    borders.append(n)
    return [(low, high, int(safe[np.searchsorted(safe, low, "right") - 1]), int(safe[np.searchsorted(safe, high)]))
            for low, high in zip(borders[:-1], borders[1:])]


def _first(a: str, b: str, chunk_bytes: int, block_bytes: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, schema = tokenizers(a, b), STORED_ARROW
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.as_buffer() is not None and text.as_buffer().size > chunk_bytes:
                    body = np.frombuffer(b" " + text.as_py().encode(), np.uint8)
                    number += 1
                    for pos, (low, high, start, end) in enumerate(ranges(body, chunk_bytes)):
                        yield _table(1, schema, block=[number], doc_id=[doc_id], pos=[pos], low=[low - start], high=[high - start],
                                     body=[body[start:end].tobytes()], kind=[CHUNKS])
                    continue
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= block_bytes or len(ids) >= BLOCK_ROWS:
                    number += 1
                    yield from _block(pair, number, ids, texts, keep)
                    ids, texts, size = [], [], 0
        if ids:
            yield from _block(pair, number + 1, ids, texts, keep)
    return run


def _range_fragment(pair: Tokenizers, body: bytes, low: int, high: int) -> Fragment:
    (a, b, same), = pair([body.decode()])
    if not same:
        return Fragment(valid=False)
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    own_a, own_b = (slice(*np.searchsorted(e, [low, high], "right")) for e in (ends_a, ends_b))
    return fragment(a[own_a], ends_a[own_a], b[own_b], ends_b[own_b])


def _to_rows(block: int, doc_id: int | None, pos: int, x: Fragment) -> dict:
    return {"block": [block], "doc_id": [doc_id], "pos": [pos], **{k: [getattr(x, k)] for k in Fragment.__dataclass_fields__}}


def _from_row(row: dict) -> Fragment:
    return Fragment(**{k: np.array(row[k], np.int64) if isinstance(row[k], list) else row[k] for k in Fragment.__dataclass_fields__})


def _fragments(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, schema = tokenizers(a, b), FRAGMENT_ARROW
        for batch in batches:
            for row in batch.to_pylist():
                yield _table(1, schema, **_to_rows(row["block"], row["doc_id"], row["pos"], _range_fragment(pair, row["body"], row["low"], row["high"])))
    return run


def _reduce(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    whole = reduce(compose, map(_from_row, rows), EMPTY)
    return pa.Table.from_batches([_table(1, FRAGMENT_ARROW, **_to_rows(rows[0]["block"], rows[0]["doc_id"], rows[0]["pos"] // FAN_IN, whole))])


def _finish(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = complete(_from_row(row))
                yield from _rows(row["block"], [row["doc_id"]], [x.n_a], [x.n_b], [x.n_groups], [x.n_links], [x.text[:-1]],
                                 np.zeros(len(x.keys), np.int64), x.keys, x.times, keep)
    return run


# --- Spark ----------------------------------------------------------------------------------------------------------------


def _store(df: DataFrame) -> DataFrame:
    """Stored by kind, so that each kind is read alone."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "alignment")
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Alignment:
    """Stored groups of all documents: ``documents()`` with their links judged by the corpus, ``pairs()`` with their counts."""

    def __init__(self, stored: DataFrame) -> None:
        self.stored = stored
        pairs = stored.filter(F.col("kind") == PAIRS)
        counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS))
        counts = cut_lineage(counts)
        best = counts.groupBy("a").agg(F.max("n").alias("most"))
        self.counts = cut_lineage(counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))

    def pairs(self) -> DataFrame:
        """a, b, n (documents that hold the pair linked), best (no other b is linked with this a in more documents)."""
        return self.counts.select(F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "n", "best")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless kept)."""
        listed = self.stored.filter(F.col("kind") == PAIRS).select(F.col("block").alias("of"), "place", "pair").join(self.counts, "pair")
        docs = self.stored.filter(F.col("kind") == BLOCKS).select(
            "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "places", "times")
        return (docs.groupBy("block").cogroup(listed.select("of", "place", "n", "best").groupBy("of"))
                .applyInArrow(_score, SCORED))


def _score(docs: pa.Table, listed: pa.Table) -> pa.Table:
    places, times = (docs.column(c).combine_chunks() for c in ("places", "times"))
    borders = places.offsets.to_numpy()
    at, n = places.values.to_numpy()[borders[0]:borders[-1]], times.values.to_numpy()[borders[0]:borders[-1]]
    size = listed.num_rows
    count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    order = listed.column("place").to_numpy()
    count[order], best[order] = listed.column("n").to_numpy(), listed.column("best").to_numpy()
    sums = [np.concatenate([[0], np.cumsum(n * values[at])])[borders - borders[0]] for values in (best, count)]
    made = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
    made |= {c: pa.array(np.diff(s)) for c, s in zip(("n_best", "count_sum"), sums)}
    return pa.table({c: made[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")})


def align(documents: DataFrame, a: str, b: str, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES,
          keep_groups: bool = False) -> Alignment:
    """Align the tokens of file ``a`` (tokenizers) and model ``b`` (sentencepiece) in every document's whole text."""
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    stored = _store(in_arrow(rows, _first(a, b, chunk_bytes, block_bytes, keep_groups), STORED))
    chunks = stored.filter(F.col("kind") == CHUNKS).select("block", "doc_id", "pos", "low", "high", "body")
    ranges_most = chunks.agg(F.max("pos")).first()[0]
    if ranges_most is not None:
        parts = cut_lineage(in_arrow(chunks.repartition("block", "pos"), _fragments(a, b), FRAGMENT))
        while ranges_most > 0:
            parts = cut_lineage(parts.groupBy("block", F.floor(F.col("pos") / FAN_IN)).applyInArrow(_reduce, FRAGMENT))
            ranges_most //= FAN_IN
        stored = stored.unionByName(_store(in_arrow(parts, _finish(keep_groups), STORED)))
    return Alignment(stored)


def spelled(groups: Iterable[tuple[list[int], list[int]]]) -> str:
    """The text of groups as digested: ``a1,a2|b1;a3|b2,b3``."""
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
