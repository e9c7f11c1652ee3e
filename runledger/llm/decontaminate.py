"""Benchmark decontamination by a positional inverted index of the training documents.

* Index: documents are cut into segments of about ``SEGMENT_WORDS`` words; each segment stores, for every test term it has, the
  ascending positions of the term (a posting list).  Terms that no test item has can't match, so their postings aren't stored.
  Documents are apart by a gap, so no phrase crosses from one to the next.
* Search: phrases are dealt out to every segment.  A phrase whose terms all occur starts from the list of its rarest term
  there; the other lists, from rare to common, are shifted by their offsets and intersected.  Proximity matching asks for each
  term within ``slop`` words of its place instead.

Terms are looked up by 64-bit hash and confirmed by a second 64-bit hash of their bytes.  The items' phrases go to the
executors ``CHUNK_PHRASES`` at a time; of all items together only the distinct terms do, with 16 bytes each.  A segment is one row;
a very long document is a segment of its own.  The index is stored in the shared folder.

Null texts have no words, items without words match nothing, and items shorter than ``size`` words are one phrase.  Repeated
documents are each judged; repeated items count once by their id.  Items with a null id hit like others, but name no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, in_arrow
from .textblocks import RunHash, blocks, rows_of, spans

WORD_BYTES = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SEGMENT_WORDS = 1 << 20
CHUNK_PHRASES = 100_000
CHUNK_ITEMS = 20_000
SEGMENT = ("part INT, segment BIGINT, doc_ids ARRAY<BIGINT>, firsts ARRAY<BIGINT>, words ARRAY<BIGINT>, terms ARRAY<INT>, ends ARRAY<BIGINT>, "
           "postings ARRAY<INT>")


class Words:
    """Positions and two hashes of the words of a block."""

    def __init__(self) -> None:
        self.first, self.second = RunHash(101), RunHash(202)

    def __call__(self, rows: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = spans(data, rows, WORD_BYTES)
        return rows_of(starts, rows), self.first(data, starts, ends), self.second(data, starts, ends)


class Terms:
    """Test terms, numbered by their first hash."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, at = np.unique(first, return_index=True)
        self.second = second[at]

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)


class Phrases:
    """Distinct phrases of test items as rows of term numbers, with the items each stands in."""

    def __init__(self, items: list[tuple[str | None, str]], size: int, terms: Terms | None = None) -> None:
        column = pa.array([text for _, text in items], pa.large_string())
        owner, first, second = [], [], []
        words = Words()
        for low, _, rows, data in blocks(column):
            o, a, b = words(rows, data)
            owner.append(o + low)
            first.append(a)
            second.append(b)
        none = np.zeros(0, np.uint64)
        owner, first, second = (np.concatenate(x) if x else none for x in (owner, first, second))
        self.terms = terms or Terms(first, second)
        number = self.terms.find(first, second)
        found: dict[tuple[int, ...], set[str]] = {}
        edges = np.searchsorted(owner, np.arange(len(items) + 1)) if len(owner) else np.zeros(len(items) + 1, int)
        for i, (item, _) in enumerate(items):
            own = number[edges[i]:edges[i + 1]].tolist()
            for k in range(max(1, len(own) - size + 1) if own else 0):
                found.setdefault(tuple(own[k:k + size]), set()).update(() if item is None else (item,))
        self.phrases = [np.array(p) for p in found]
        self.items = [sorted(x) for x in found.values()]

    def part(self, low: int, high: int) -> Phrases:
        """Some of the phrases; the terms stay behind, the search does not need them."""
        out = Phrases([], 1, Terms(np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
        out.phrases, out.items = self.phrases[low:high], self.items[low:high]
        return out


def _index(shared, gap: int):
    """Rows of SEGMENT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, words = shared.value, Words()
        docs: list[tuple[int, int, int]] = []
        found: list[np.ndarray] = []
        places: list[np.ndarray] = []
        at, part, made = 0, TaskContext.get().partitionId(), 0

        def segment() -> pa.RecordBatch:
            term = np.concatenate(found) if found else np.zeros(0, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            order = np.argsort(term, kind="stable")
            used, counts = np.unique(term, return_counts=True)
            row = [[d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], used.astype(np.int32), np.cumsum(counts), place[order].astype(np.int32)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, kinds)]
            docs.clear()
            found.clear()
            places.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int64()), *lists], ["part", "segment", "doc_ids", "firsts", "words", "terms", "ends", "postings"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, rows, data in blocks(batch.column(1)):
                owner, first, second = words(rows, data)
                counts = np.bincount(owner, minlength=high - low)
                before = np.cumsum(counts) - counts
                starts = at + before + gap * np.arange(high - low)
                term = terms.find(first, second)
                hit = np.flatnonzero(term >= 0)
                found.append(term[hit])
                places.append(starts[owner[hit]] + hit - before[owner[hit]])
                docs.extend(zip(ids[low:high], starts.tolist(), counts.tolist()))
                at = int(starts[-1] + counts[-1] + gap)
                if at >= SEGMENT_WORDS:
                    yield segment()
                    at, made = 0, made + 1
        if docs:
            yield segment()
    return run


def build_index(documents: DataFrame, terms: Terms, gap: int) -> DataFrame:
    """The stored positional index of whole documents (doc_id, text) for the given terms."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(in_arrow(rows, _index(shared, gap), SEGMENT))


def _members(values: np.ndarray, ascending: np.ndarray, slop: int) -> np.ndarray:
    """Which values have an entry of the list within ``slop`` of them."""
    at = np.searchsorted(ascending, values - slop)
    inside = at < len(ascending)
    inside[inside] = ascending[at[inside]] <= values[inside] + slop
    return inside


def occurrences(phrase: np.ndarray, lists: dict[int, np.ndarray], slop: int = 0) -> tuple[np.ndarray, int]:
    """Starts of the phrase, and the rarest term's offset: lists shifted by their offsets, intersected from the rarest term to the most common."""
    order = sorted(range(len(phrase)), key=lambda k: len(lists[phrase[k]]))
    starts = lists[phrase[order[0]]].astype(np.int64) - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        starts = starts[_members(starts + k, lists[phrase[k]], slop)]
    return starts, order[0]


def _search(shared, slop: int):
    """Per document: number, doc_id, words, runs of hit words as (start, end) within the document, items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        longest = max((len(p) for p in phrases.phrases), default=1)
        table = np.full((len(phrases.phrases), longest), -1)
        for i, p in enumerate(phrases.phrases):
            table[i, :len(p)] = p
        for batch in batches:
            for r in range(len(batch)):
                part, made = batch.column(0)[r].as_py(), batch.column(1)[r].as_py() << 32
                ids, firsts, words, terms, ends, postings = (batch.column(c)[r].values for c in range(2, 8))
                firsts, words, terms, ends, postings = (x.to_numpy() for x in (firsts, words, terms, ends, postings))
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                lists = {int(t): postings[a:b] for t, a, b in zip(terms, begin, ends)}
                have = np.zeros(int(table.max(initial=0)) + 2, bool)  # the last one stands for the places past a phrase's end
                have[terms[terms < len(have) - 1]] = True
                have[-1] = True
                hits: dict[int, list[tuple[int, int]]] = {}
                names: dict[int, set[str]] = {}
                for i in np.flatnonzero(have[table].all(1)):
                    starts, rarest = occurrences(phrases.phrases[i], lists, slop)
                    for start in starts.tolist():
                        # with slop a start may lie before its document, the rarest term never does
                        d = int(np.searchsorted(firsts, start + rarest, "right")) - 1
                        begin_, end_ = start - int(firsts[d]), start - int(firsts[d]) + len(phrases.phrases[i])
                        hits.setdefault(d, []).append((max(begin_, 0), min(end_, int(words[d]))))
                        names.setdefault(d, set()).update(phrases.items[i])
                runs = [_merge(hits.get(d, [])) for d in range(len(firsts))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(firsts), pa.int32()), pa.array(range(made, made + len(firsts)), pa.int64()), ids, pa.array(words),
                     pa.array([[{"start": a, "end": b} for a, b in x] for x in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array([sorted(names.get(d, ())) for d in range(len(firsts))], pa.list_(pa.string()))],
                    ["part", "number", "doc_id", "n_words", "hits", "items"])
    return run


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "part INT, number BIGINT, doc_id BIGINT, n_words BIGINT, hits ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, items ARRAY<STRING>"


def _chunks(rows: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The items in id order, null ids first, a bounded number at a time."""
    rows = rows.select(F.when(F.col("item_id").isNull(), "").otherwise(F.concat(F.lit("="), "item_id")).alias("_item"), "text").distinct()
    last: tuple[str, str] | None = None
    while True:
        more = rows if last is None else rows.filter((F.col("_item") > last[0]) | ((F.col("_item") == last[0]) & (F.col("text") > last[1])))
        found = [(r[0], r[1]) for r in more.orderBy("_item", "text").limit(CHUNK_ITEMS).collect()]
        if found:
            yield [(item[1:] if item else None, text) for item, text in found]
        if len(found) < CHUNK_ITEMS:
            return
        last = found[-1]


def matches(documents: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, hits (merged runs of word positions, end excluded) and items of each document.

    ``slop`` > 0 gives proximity matches: every term of a phrase within ``slop`` words of its place.
    """
    context, found = documents.sparkSession.sparkContext, []
    rows = cut_lineage(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
                       .filter("text IS NOT NULL"))
    terms = Terms(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for chunk in _chunks(rows):
        own = Phrases(chunk, size).terms
        terms = Terms(np.concatenate([terms.first, own.first]), np.concatenate([terms.second, own.second]))
    index = build_index(documents, terms, size + 2 * slop + 1)

    def search(phrases: Phrases) -> None:
        found.append(index.mapInArrow(_search(context.broadcast(phrases), slop), FOUND))

    for chunk in _chunks(rows):
        phrases = Phrases(chunk, size, terms)
        for low in range(0, len(phrases.phrases), CHUNK_PHRASES):
            search(phrases.part(low, low + CHUNK_PHRASES))
    if not found:
        search(Phrases([], size, terms))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if len(found) == 1:
        return every.drop("part", "number")
    # a document is known by its place in the stored index
    merged = every.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                                 F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
                                                 F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.withColumn("hits", F.aggregate(
        "hits", F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(F.col("hits"), 1).isNotNull()) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
                               F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                                        F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                                                         F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(x))))).drop("part", "number")


def contamination(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and hits, items) of each document."""
    covered = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return (matches(documents, items, size).withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
            .withColumn("contaminated", F.col("n_hit") > 0)
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"))


def decontaminated(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents, all columns, without those that hold a phrase of an item. Texts, not ids, are looked up."""
    text = F.col("text").cast("string")
    asked = documents.filter("text IS NOT NULL").select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    hit = contamination(asked, items, size).filter("contaminated").select(F.col("doc_id").alias("_hash")).distinct()
    rows = documents.select(F.struct("*").alias("_row"), F.when(text.isNotNull(), F.xxhash64(text)).alias("_mine"))
    return rows.join(hit, F.col("_mine") == F.col("_hash"), "left_anti").select("_row.*")
