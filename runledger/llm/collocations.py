"""Collocations: phrases of two to ``longest`` words, counted exactly and scored by their weakest cut.

* Texts are cut into words once and stored as blocks of numbered words, which all later passes read.
* Candidates are found level by level, Apriori-safe.  Words are counted exactly.  Longer phrases are first counted by 64-bit hashes,
  only where both parts one word shorter may be frequent; a task's hashes are sorted, counted and sent as one row for each range of
  hashes.  Hashes that reach the minimum set bits of a map of at most ``MAP_BITS``, which is broadcast.  Collisions only let more
  phrases through.
* Phrases that pass are the candidates.  They are dealt by that hash into double-array tries of at most about ``TRIE_BYTES`` and
  ``GROUP_WORDS``.  A word is two digits of the trie's alphabet.  Each trie is built in one task, and positions that pass the maps go to
  the one trie their phrase is dealt to: numpy advances the states of many positions at once, digit by digit.  Up to ``SCAN_TRIES`` tries
  (small tables) are broadcast and run over all blocks, and Spark sums the tasks' counts.  More tries stay in their tasks, and a block's
  phrases are sent to them, equal ones once with their number.  So the number of scans does not grow with the candidates.
* Scores are exact integers: floor(1000000 a a / (l r)) in decimals of 38 digits.

Texts that are null or empty have no words; a null language is ``und``.  Repeated rows and ids count as often as they occur; doc_id is
not looked at, nor any column besides text and lang.  An empty table has no phrases.  Ties are ordered by a, then by phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranks import newest
from .common import cut_lineage, in_arrow, scratch_path, spread
from .textblocks import RunHash, blocks, mix, spans

SCALE = 1_000_000
MAP_BITS = 1 << 27
#: Where a hash's three places in a map begin.
PLACES = (0, 18, 36)
TRIE_BYTES, SCAN_TRIES = 6 << 20, 4
#: Estimated bytes of a trie for each candidate besides its text.
NODE_BYTES = 48
BUFFER = 1 << 21
#: Bytes of a stored block's texts, and how many of all words a group has that is counted at once.
BLOCK_BYTES, GROUP_WORDS = 4 << 20, 1 << 21
#: Estimated bytes of a candidate's text.
PHRASE_BYTES = 24
END_OF_PIECE = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
IN_WORD = ~END_OF_PIECE & np.array([b not in (32, 9) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- words of texts -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """The words of a block's texts in one language: distinct ones, their numbers in order, and how many words of its piece each
    still has before it, itself included."""

    lang: str
    distinct: pa.StringArray
    code: np.ndarray
    room: np.ndarray

    def hashes(self, run: RunHash) -> np.ndarray:
        """64-bit hashes of the distinct words, other ones for other languages."""
        _, places, data = self.distinct.buffers()
        ends = np.frombuffer(places, np.int32, len(self.distinct) + 1).astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        name = np.frombuffer(self.lang.encode() or b"\0", np.uint8)
        salt = run(name, np.array([0]), np.array([len(name)]))
        return mix(run(raw[:ends[-1]], ends[:-1], ends[1:]) ^ mix(salt, 7))


def words(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[Words]:
    """The words of a batch of (lang, text), a language and about ``limit`` bytes at a time; a longer text is not cut."""
    langs = batch.column(0).dictionary_encode()
    numbers = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = batch.column(1).filter(pa.array(numbers == k))
        for _, _, rows, data in blocks(own, limit):
            data = LOWER[data]
            starts, ends = spans(data, rows, IN_WORD)
            if not len(starts):
                continue
            sizes = ends - starts
            places = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(sizes, out=places[1:])
            text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[IN_WORD[data]]))
            coded = text.dictionary_encode()
            ends_piece = np.append(END_OF_PIECE[data], False)
            ends_piece[rows] = True
            piece = np.cumsum(ends_piece, dtype=np.int32)[starts]
            after = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece))
            room = np.repeat(after, np.diff(after, prepend=0)) - np.arange(len(piece))
            yield Words(lang, coded.dictionary, coded.indices.to_numpy(), room)


BLOCKS = "lang STRING, places BINARY, data BINARY, code BINARY, room BINARY, n BIGINT"


def _coded(longest: int) -> Callable:
    """The words of (lang, text) as rows of :data:`BLOCKS`; of what is left of a piece no more than ``longest`` words count."""
    room = np.min_scalar_type(longest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for w in words(pa.concat_batches(held), BLOCK_BYTES):
                _, places, data = w.distinct.buffers()
                ends = np.frombuffer(places, np.int32, len(w.distinct) + 1)
                code = w.code.astype(np.min_scalar_type(len(w.distinct)))
                parts = [ends, np.frombuffer(data, np.uint8, ends[-1]), code, np.minimum(w.room, longest).astype(room)]
                yield pa.RecordBatch.from_arrays([pa.array([w.lang], pa.string()), *[pa.array([x.tobytes()], pa.binary()) for x in parts],
                                                  pa.array([len(code)])], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 2 * BLOCK_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()
    return work


def stored_words(rows: DataFrame, longest: int) -> DataFrame:
    """The words of (lang, text) as a stored table of :data:`BLOCKS`, in row groups of a few blocks."""
    path = scratch_path(rows.sparkSession, "words")
    in_arrow(rows, _coded(longest), BLOCKS).write.options(**{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1,
                                                             "parquet.enable.dictionary": "false"}).parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


def words_of(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch of texts, or of :data:`BLOCKS`."""
    if "text" in batch.schema.names:
        yield from words(batch)
        return
    for lang, places, data, code, room in zip(batch.column(0).to_pylist(), *[[x.as_buffer() for x in c] for c in batch.columns[1:5]]):
        distinct = pa.StringArray.from_buffers(places.size // 4 - 1, places, data)
        for kind in (np.uint8, np.uint16, np.uint32):
            if len(distinct) <= np.iinfo(kind).max:
                break
        numbers = np.frombuffer(code, kind)
        yield Words(lang, distinct, numbers.astype(np.int64), np.frombuffer(room, np.dtype(f"u{room.size // len(numbers)}")))


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.BinaryArray:
    """The bytes of the values between each two cuts."""
    places = (cuts * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))])


DEALT = "part BIGINT, lang STRING, size INT, text STRING, n BINARY"


def dealt(lang: str, size: int, phrases: Callable, hashes: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Phrases of ``size`` words (``phrases`` of an order) and how often each occurs, dealt by their hashes: a row for each part, a phrase a line."""
    part = np.mod(hashes.view(np.int64), parts)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    cuts = np.append(first, len(order))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), phrases(order)), "\n")
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array([size] * len(own), pa.int32()),
                                       lines, blobs(n[order].astype(np.int32), cuts)], [c.split()[0] for c in DEALT.split(", ")])


def _word_counts(parts: int) -> Callable:
    """How often each block has each word, as :data:`DEALT`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = RunHash(1201)
        for batch in batches:
            for w in words_of(batch):
                n = np.bincount(w.code, minlength=len(w.distinct))
                yield dealt(w.lang, 1, lambda order: w.distinct.take(pa.array(order)), w.hashes(run), n, parts)  # noqa: B023
    return work


def _counted_words(table: pa.Table) -> pa.Table:
    """lang, word, hash, n of the words of one part."""
    run, out = RunHash(1201), []
    for lang in table.column("lang").unique().to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang))
        lines = pa.concat_arrays([x.flatten() for x in pc.split_pattern(own.column("text"), "\n").chunks])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in own.column("n")]).astype(np.int64)
        added = pa.table([lines, pa.array(n)], ["word", "n"]).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        names, none = pa.concat_arrays(added.column("word").chunks), np.zeros(0, np.int64)
        hashes = Words(lang, names, none, none).hashes(run)
        out.append(pa.table([pa.array([lang] * len(names), pa.string()), names, pa.array(hashes.view(np.int64)), added.column("n_sum")], ["lang", "word", "hash", "n"]))
    return pa.concat_tables(out)


# --- candidates -----------------------------------------------------------------------------------------------------------


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all places of each hash have their bit."""
    out = np.ones(len(hashes), bool)
    for shift in PLACES:
        at = (hashes >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


class Levels:
    """Hashes of the phrases at all positions, and which of them may be frequent, by the maps of the levels so far."""

    def __init__(self, w: Words, run: RunHash, maps: list[np.ndarray]) -> None:
        self.w, self.distinct = w, w.hashes(run)
        self.word = self.distinct[w.code]
        self.hash, self.size = self.word, 1
        self.alive = np.ones(len(w.code), bool)
        #: Of the distinct words, those that may be frequent.
        self.frequent = has_bit(maps[0], self.distinct)
        self.maybe = self.frequent[w.code]
        for bits in maps[1:]:
            self.judge(bits)

    def grow(self) -> None:
        """To phrases of one word more: those whose two parts may be frequent are alive."""
        self.size += 1
        self.alive = self.maybe & np.append(self.maybe[1:], False) & (self.w.room >= self.size)
        at = np.flatnonzero(self.alive)  # the others stay dead
        longer = np.zeros(len(self.hash), np.uint64)
        longer[at] = mix(mix(self.hash[at], self.size) ^ self.word[at + self.size - 1], 99)
        self.hash = longer

    def judge(self, bits: np.ndarray) -> None:
        """To phrases of one word more, and which of them may be frequent by their map."""
        self.grow()
        self.maybe = self.alive.copy()
        self.maybe[self.alive] = has_bit(bits, self.hash[self.alive])

    def tally(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A position, the hash and the number of each of the phrases that may be frequent. Phrases of one hash stay apart."""
        at = np.flatnonzero(self.maybe)
        hashes = self.hash[at]
        order = np.argsort(hashes)
        at, hashes = at[order], hashes[order]
        first = np.ones(len(at), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        group = np.cumsum(first) - 1
        start = at[np.flatnonzero(first)]
        other = np.zeros(len(at), bool)
        for k in range(self.size):
            other |= self.w.code[at + k] != self.w.code[start[group] + k]
        n = np.bincount(group, ~other, minlength=len(start)).astype(np.int64)
        if other.any():  # each position of these for itself
            start, hashes, n = np.concatenate([start, at[other]]), np.concatenate([hashes[first], hashes[other]]), np.concatenate([n, np.ones(other.sum(), np.int64)])
        else:
            hashes = hashes[first]
        return start, hashes, n

    def phrases(self, at: np.ndarray) -> pa.Array:
        """The phrases at some positions."""
        if not len(at):
            return pa.array([], pa.string())
        return pc.binary_join_element_wise(*[self.w.distinct.take(pa.array(self.w.code[at + k])) for k in range(self.size)], " ")

    def names(self) -> tuple[pa.Array, pa.Array]:
        """The distinct phrases that may be frequent, and their hashes."""
        at, hashes, _ = self.tally()
        return self.phrases(at), pa.array(hashes.view(np.int64))


def _hash_counts(maps: Broadcast, groups: int) -> Callable:
    """Hashes of the next level's phrases and how often they occur, as a row for each range of hashes: (part, hashes, n)."""
    edges = np.array([k * (2 ** 64 // groups) for k in range(1, groups)], np.uint64)

    def tallied(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), blobs(hashes, cuts), blobs(n.astype(np.uint32), cuts)], ["part", "hashes", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, size = RunHash(1201), [], 0
        for batch in batches:
            for w in words_of(batch):
                level = Levels(w, run, maps.value)
                level.grow()
                held.append(level.hash[level.alive])
                size += len(held[-1])
                if size >= BUFFER:
                    yield tallied(held)
                    held, size = [], 0
        if size:
            yield tallied(held)
    return work


def _frequent(least: int) -> Callable:
    """The hashes of one range that occur ``least`` times."""
    def work(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)])
        enough = np.add.reduceat(n, first) >= least if len(first) else np.zeros(0, bool)
        return pa.table({"hash": pa.array(hashes[first[enough]].view(np.int64))})
    return work


def _dealt(maps: Broadcast, parts: int) -> Callable:
    """The phrases at the positions that pass the maps, and how often a block has each, as :data:`DEALT`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = RunHash(1201)
        for batch in batches:
            for w in words_of(batch):
                level = Levels(w, run, maps.value[:1])
                for bits in maps.value[1:]:
                    level.judge(bits)
                    at, hashes, n = level.tally()
                    yield dealt(w.lang, level.size, lambda order: level.phrases(at[order]), hashes, n, parts)  # noqa: B023
    return work


def _map(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the hashes as 64-bit words: 32 bits or more for each hash, MAP_BITS at most; and how many hashes there are.
    Words with a bit come to the driver."""
    count = hashes.count()
    size = max(64, min(MAP_BITS, 1 << (32 * count).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("hash", shift).bitwiseAND(size - 1) for shift in PLACES])).alias("at")
    words_ = hashes.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    found = words_.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, count


# --- double-array tries ---------------------------------------------------------------------------------------------------


class Trie:
    """A double-array trie of phrases: state s goes by digit d to base[s] + d if check says that this slot is a child of s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray, bits: int, langs: list[str] | pa.Array,
                 vocabulary: list[str] | pa.Array) -> None:
        self.base, self.check, self.accept, self.bits, self.run = base, check, accept, bits, RunHash(1201)
        self.phrases = int(accept.max(initial=-1)) + 1
        #: Of each language: hashes of its words in ascending order, the words, their numbers.
        self.listed: dict[str, tuple[np.ndarray, pa.Array, np.ndarray]] = {}
        coded, none = pa.array(langs, pa.string()).dictionary_encode(), np.zeros(0, np.int64)
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = np.flatnonzero(coded.indices.to_numpy() == k)
            names = pa.array(vocabulary, pa.string()).take(pa.array(own))
            hashes = Words(lang, names, none, none).hashes(self.run)
            order = np.argsort(hashes, kind="stable")
            self.listed[lang] = hashes[order], names.take(pa.array(order)), own[order]

    def numbers(self, w: Words, hashes: np.ndarray | None = None, listed: np.ndarray | None = None) -> np.ndarray:
        """The trie's number of each distinct word (of those ``listed``), -1 for others: found by hash, confirmed by the words."""
        out = np.full(len(w.distinct), -1, np.int64)
        if w.lang not in self.listed:
            return out
        keys, names, number = self.listed[w.lang]
        at = np.arange(len(out)) if listed is None else np.flatnonzero(listed)
        own = (w.hashes(self.run) if hashes is None else hashes)[at]
        place = np.searchsorted(keys, own)
        while len(at):  # again only for words whose hash is that of another word
            known = place < len(keys)
            known[known] = keys[place[known]] == own[known]
            at, own, place = at[known], own[known], place[known]
            same = pc.equal(names.take(pa.array(place)), w.distinct.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(bool)
            out[at[same]] = number[place[same]]
            at, own, place = at[~same], own[~same], place[~same] + 1
        return out

    def advance(self, at: np.ndarray, state: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and states that are left after one word more."""
        for shift, mask in ((self.bits, -1), (0, (1 << self.bits) - 1)):
            slot = self.base[state] + np.maximum((following >> shift) & mask, 0)
            good = (self.check[slot] == state) & (following >= 0)
            at, state, following = at[good], slot[good], following[good]
        return at, state

    def accepted(self, state: np.ndarray) -> np.ndarray:
        accepted = self.accept[state]
        return accepted[accepted >= 0]

    def found(self, w: Words, longest: int) -> list[np.ndarray]:
        """Numbers of the phrases found, once for each occurrence: all positions advance at once, level by level."""
        word, out = self.numbers(w)[w.code], []
        at, state = np.arange(len(word)), np.zeros(len(word), np.int64)
        for k in range(longest):
            inside = (w.room[at] > k)
            at, state = at[inside], state[inside]
            at, state = self.advance(at, state, word[at + k])
            out.append(self.accepted(state))
        return out

    def reached(self, w: Words, number: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and states that are left after ``size`` words, by the :meth:`numbers` of the words."""
        state = np.zeros(len(at), np.int64)
        for k in range(size):
            at, state = self.advance(at, state, number[w.code[at + k]])
        return at, state

    def found_at(self, w: Words, number: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the phrases of ``size`` words at some positions."""
        return self.accepted(self.reached(w, number, at, size)[1])


def build(phrases: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, list[tuple[str, str]]]:
    """Base, check, accepted phrase of each slot, bits of a digit, and the (language, word) of each word number."""
    vocabulary: dict[tuple[str, str], int] = {}
    coded = [[vocabulary.setdefault((lang, word), len(vocabulary)) for word in phrase.split(" ")] for lang, phrase in phrases]
    bits = (max(len(vocabulary) - 1, 1).bit_length() + 1) // 2
    depth = max(map(len, coded), default=0)
    word = np.full((len(coded), depth), -1, np.int64)
    for k in range(depth):
        word[:, k] = [c[k] if k < len(c) else -1 for c in coded]
    node, parent, digit = np.zeros(len(coded), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    nodes = 1
    for k in range(depth):
        rows = np.flatnonzero(word[:, k] >= 0)
        for own in (word[rows, k] >> bits, word[rows, k] & ((1 << bits) - 1)):
            edges, place = np.unique((node[rows] << bits) | own, return_inverse=True)
            parent.append(edges >> bits)
            digit.append(edges & ((1 << bits) - 1))
            node[rows] = nodes + place
            nodes += len(edges)
    parent, digit = np.concatenate(parent), np.concatenate(digit)
    slot, base_of = _place(parent, digit, nodes, bits)
    size = int(slot.max()) + (2 << bits)
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent[1:]]
    accept[slot[node]] = np.arange(len(coded))
    return base, check, accept, bits, list(vocabulary)


def _place(parent: np.ndarray, digit: np.ndarray, nodes: int, bits: int, window: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Slot and base of every node. Nodes with many children come first, each class of sizes from the front, into the first gaps that
    fit all of a node's children; single children fill what is left."""
    n = np.bincount(parent[1:], minlength=nodes)
    first = 1 + np.cumsum(n) - n  # children lie together, in the order of their parents
    used = np.zeros((4 << bits) + 2 * nodes + window, bool)
    base_of = np.zeros(nodes, np.int64)
    several = np.flatnonzero(n > 1)
    several = several[np.argsort(-n[several], kind="stable")]
    low, size_class = 1 << bits, 0
    for p in several:
        children = digit[first[p]:first[p] + n[p]]
        if int(n[p]).bit_length() != size_class:
            low, size_class = 1 << bits, int(n[p]).bit_length()
        apart = children - children[0]
        while True:
            if low + window + (1 << bits) > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            gaps = np.flatnonzero(~used[low:low + window])[:64] + low
            fits = ~used[gaps[:, None] + apart].any(axis=1) if len(gaps) else np.zeros(1, bool)
            if fits.any():
                break
            low += window // 2
        gap = gaps[np.argmax(fits)]
        used[gap + apart] = True
        base_of[p] = gap - children[0]
    single = np.flatnonzero(n == 1)
    gaps = np.flatnonzero(~used[1 << bits:])[:len(single)] + (1 << bits)
    gaps = np.concatenate([gaps, len(used) + np.arange(len(single) - len(gaps))])
    base_of[single] = gaps - digit[first[single]]
    slot = base_of[parent] + digit
    slot[0] = 0
    return slot, base_of


def named(rows: pa.Table) -> list[tuple[str, str]]:
    """The distinct (lang, phrase) of :data:`DEALT` rows, in order."""
    out = []
    for lang in sorted(rows.column("lang").unique().to_pylist()):
        own = rows.filter(pc.equal(rows.column("lang"), lang)).column("text")
        found = pa.chunked_array([x.flatten() for x in pc.split_pattern(own, "\n").chunks], pa.string()).unique()
        out += [(lang, phrase) for phrase in found.take(pc.sort_indices(found)).to_pylist()]
    return out


BUILT = ("chunk BIGINT, number BIGINT, lang STRING, phrase STRING, base BINARY, check BINARY, accept BINARY, bits INT, langs ARRAY<STRING>, "
         "vocabulary ARRAY<STRING>")


def _built(table: pa.Table) -> pa.Table:
    """Each phrase of a part with its number, and one row with the part's trie."""
    listed = named(table)
    base, check, accept, bits, vocabulary = build(listed)
    n, chunk = len(listed), table.column("part")[0].as_py()
    langs, phrases = [x[0] for x in listed], [x[1] for x in listed]
    strings = pa.list_(pa.string())
    names = [pa.array(np.full(n, chunk)), pa.array(np.arange(n)), pa.array(langs, pa.string()), pa.array(phrases, pa.string()),
             *[pa.nulls(n, pa.binary())] * 3, pa.nulls(n, pa.int32()), *[pa.nulls(n, strings)] * 2]
    trie = [pa.array([chunk]), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 2, *[pa.array([x.tobytes()]) for x in (base, check, accept)],
            pa.array([bits], pa.int32()), *[pa.array([[v[k] for v in vocabulary]], strings) for k in (0, 1)]]
    columns = [c.split()[0] for c in BUILT.split(", ")]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(names, columns), pa.RecordBatch.from_arrays(trie, columns)])


def _counted(least: int) -> Callable:
    """lang, phrase, a of the phrases that occur ``least`` times, from :data:`DEALT` rows in the order of their parts: a trie of a part's
    phrases looks all of them up."""
    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        listed = named(rows)
        base, check, accept, bits, vocabulary = build(listed)
        trie = Trie(base, check, accept, bits, [v[0] for v in vocabulary], [v[1] for v in vocabulary])
        total = np.zeros(trie.phrases, np.int64)
        for size in rows.column("size").unique().to_pylist():
            for lang in rows.column("lang").unique().to_pylist():
                own = rows.filter(pc.and_(pc.equal(rows.column("lang"), lang), pc.equal(rows.column("size"), size)))
                if not own.num_rows:
                    continue
                n, done = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in own.column("n")]), 0
                for w in words(own.select(["lang", "text"]).combine_chunks().to_batches()[0]):
                    at, state = trie.reached(w, trie.numbers(w), np.arange(0, len(w.code), size), size)
                    number = trie.accept[state]
                    np.add.at(total, number[number >= 0], n[done + at[number >= 0] // size])
                    done += len(w.code) // size
        often = np.flatnonzero(total >= least)
        phrases = [listed[k] for k in often]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in phrases], pa.string()), pa.array([x[1] for x in phrases], pa.string()), pa.array(total[often])],
                                          ["lang", "phrase", "a"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for low, high in zip(cuts, cuts[1:]):
                if held and high > low and held[0].column("part")[0].as_py() != part[low]:
                    yield counted(held)
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield counted(held)
    return work


def _found(shared: Broadcast, maps: Broadcast, chunks: int) -> Callable:
    """Counts of the tries' phrases: each position that passes the maps is looked up in the trie its phrase is dealt to."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, tries = RunHash(1201), {chunk: Trie(*parts) for chunk, parts in shared.value.items()}
        total = {chunk: np.zeros(trie.phrases, np.int64) for chunk, trie in tries.items()}
        held: dict[int, list[np.ndarray]] = {chunk: [] for chunk in tries}
        waiting = 0

        def add() -> None:
            for chunk, found in held.items():
                if found:
                    total[chunk] += np.bincount(np.concatenate(found), minlength=len(total[chunk]))
                found.clear()

        for batch in batches:
            for w in words_of(batch):
                level = Levels(w, run, maps.value[:1])
                numbers = {chunk: trie.numbers(w, level.distinct, level.frequent) for chunk, trie in tries.items()}
                for bits in maps.value[1:]:
                    level.judge(bits)
                    at = np.flatnonzero(level.maybe)
                    dealt = np.mod(level.hash[at].view(np.int64), chunks)
                    for chunk, trie in tries.items():
                        found = trie.found_at(w, numbers[chunk], at[dealt == chunk], level.size)
                        held[chunk].append(found)
                        waiting += len(found)
            if waiting >= BUFFER:
                add()
                waiting = 0
        add()
        for chunk, n in total.items():
            number = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), chunk)), pa.array(number), pa.array(n[number])], ["chunk", "number", "n"])
    return work


# --- Spark ----------------------------------------------------------------------------------------------------------------


def _maps(held: DataFrame, counted: DataFrame, groups: int, least: int, longest: int) -> tuple[Broadcast, int]:
    """The maps of all levels, and about how many phrases of two and more words pass them."""
    context = held.sparkSession.sparkContext
    bits, _ = _map(counted.filter(F.col("n") >= least))
    maps, passing = [bits], 0.0
    while len(maps) < longest:
        hashes = in_arrow(held, _hash_counts(context.broadcast(maps), groups), "part BIGINT, hashes BINARY, n BINARY")
        bits, count = _map(cut_lineage(hashes.groupBy("part").applyInArrow(_frequent(least), "hash BIGINT")))
        maps = [*maps, bits]
        passing += count + GROUP_WORDS * groups * (np.bitwise_count(bits).sum() / (64 * len(bits))) ** len(PLACES)
    return context.broadcast(maps), int(passing)


def frequencies(held: DataFrame, counted: DataFrame, groups: int, least: int, longest: int) -> DataFrame:
    """lang, phrase, a: exact counts of the phrases of two to ``longest`` words that occur at least ``least`` times."""
    spark = held.sparkSession
    maps, passing = _maps(held, counted, groups, least, longest)
    parts = max(groups, 1 + passing * (NODE_BYTES + PHRASE_BYTES) // TRIE_BYTES)
    if parts > SCAN_TRIES:
        rows = in_arrow(held, _dealt(maps, parts), DEALT).repartition(parts, "part").sortWithinPartitions("part")
        return cut_lineage(in_arrow(rows, _counted(least), "lang STRING, phrase STRING, a BIGINT"))
    built = cut_lineage(in_arrow(held, _dealt(maps, parts), DEALT).groupBy("part").applyInArrow(_built, BUILT))
    rows = built.filter(F.col("number").isNull()).select("chunk", "base", "check", "accept", "bits", "langs", "vocabulary").toArrow()
    tries = {rows.column("chunk")[k].as_py(): (*[np.frombuffer(rows.column(c)[k].as_buffer(), np.int32) for c in ("base", "check", "accept")],
                                               rows.column("bits")[k].as_py(), *[rows.column(c)[k].values for c in ("langs", "vocabulary")]) for k in range(rows.num_rows)}
    shards = in_arrow(held, _found(spark.sparkContext.broadcast(tries), maps, parts), "chunk BIGINT, number BIGINT, n BIGINT")
    sums = cut_lineage(shards.groupBy("chunk", "number").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    names = built.filter(F.col("number").isNotNull()).select("chunk", "number", "lang", "phrase")
    return cut_lineage(names.join(sums, ["chunk", "number"]).select("lang", "phrase", "a"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (left right)) of three columns, exact for counts below 10^15."""
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    top = (whole(a) * whole(a) * F.lit(SCALE).cast("decimal(7,0)")).alias("_top")
    below = whole(left) * whole(right)
    return F.call_function("div", top, below)


def collocations(documents: DataFrame, least: int = 10, longest: int = 3, keep: int = 2000, percent: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``keep`` highest-scoring phrases of each language.

    A phrase is dropped if a longer one that holds it occurs at least ``percent`` / 100 times as often.
    """
    rows = spread(documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    held = stored_words(rows, longest)
    groups = 1 + (held.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS
    counted = cut_lineage(in_arrow(held, _word_counts(groups), DEALT).groupBy("part").applyInArrow(_counted_words, "lang STRING, word STRING, hash BIGINT, n BIGINT"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = frequencies(held, counted, groups, least, longest)
    parts = phrases.unionByName(counted.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))

    split = F.split("phrase", " ")
    cut = lambda first, n: F.array_join(F.slice(F.col("_words"), first, n), " ")
    cuts = (phrases.withColumn("_words", split).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)))
            .withColumn("_left", cut(F.lit(1), F.col("_k"))).withColumn("_right", cut(F.col("_k") + 1, F.size("_words") - F.col("_k"))).drop("_words"))
    count_of = lambda name, out: parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    scored = (cuts.join(count_of("_left", "l"), ["lang", "_left"]).join(count_of("_right", "r"), ["lang", "_right"])
              .withColumn("score", score("a", "l", "r")))
    lowest = (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
              .select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score")))

    n_words = F.size("_words")
    inner = (phrases.withColumn("_words", split).filter(n_words > 2)
             .withColumn("_size", F.explode(F.sequence(F.lit(2), n_words - 1)))
             .withColumn("_first", F.explode(F.sequence(F.lit(1), n_words - F.col("_size") + 1)))
             .select("lang", cut(F.col("_first"), F.col("_size")).alias("phrase"), F.col("a").alias("_longer"))
             .groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer")))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < percent * F.col("a"), F.lit(True))).drop("_longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = newest(kept, ["lang"], order, keep)
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
