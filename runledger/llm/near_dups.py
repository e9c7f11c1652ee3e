"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

* Sketch: every shingle is thrown into one of ``SLOTS`` slots per round and a slot keeps the smallest value of the first round
  that reached it; from round ``SLOTS`` on, round r fills slot r - SLOTS from all shingles, so after 2 x SLOTS rounds every
  coordinate is filled.  Documents stop as soon as they are full: about one round for long ones.
* Equal shingle sets are one class (counts and hashes, combined before the shuffle); only classes go on.
* Bands of ``ROWS`` coordinates make buckets.  In each bucket every class is checked against a leader, the class that shares most
  bands with others, never all pairs.  Classes that have too many shingles of their own to be similar to any other are then
  set aside; while leaders of the remaining components still find links, up to ``STAR_ROUNDS`` times, they are asked too; what
  is left in different components of a bucket is compared in blocks, whole texts against whole texts, of which only the links
  come out.  So no candidate pair is left out or emitted, and large groups of near copies cost a few rows per member.
* Verification counts common shingles of the two whole texts.  A leader with many members is dealt to chunks of them.
* Components take the smallest id over confirmed links, by label passing with shortcuts over stored tables.

A pair at similarity 0.8 shares one of the 40 bands of 6 with probability 1 - 5e-6.

Null texts and texts without words have an empty set (0 shingles) and are linked with nothing.  A null id is never the name
of a component if there is another; a component of null ids alone has a null name and its rows are kept.  Repeated rows are
copies of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, in_arrow
from .textblocks import RunHash, blocks, mix, rows_of, spans

WORD_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ROWS, BANDS = 6, 40
SLOTS = ROWS * BANDS
STAR_ROUNDS = 4
CHUNK_MEMBERS = 128


class Shingles:
    """Distinct shingle hashes of each text of a column."""

    def __init__(self, width: int) -> None:
        self.width, self.hash = width, RunHash(303)

    def __call__(self, column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, rows' borders, ascending distinct hashes of each row) block by block."""
        for low, high, rows, data in blocks(column, limit):
            starts, ends = spans(data, rows, WORD_BYTES)
            word = self.hash(data, starts, ends)
            owner = rows_of(starts, rows)
            edges = np.searchsorted(owner, np.arange(high - low + 1))
            n = np.diff(edges)
            code = np.zeros(max(len(word) - self.width + 1, 0), np.uint64)
            for k in range(self.width):
                code = mix(code ^ word[k:k + len(code)], k)
            out, borders = [], np.zeros(high - low + 1, np.int64)
            for i in range(high - low):
                if n[i] >= self.width:
                    own = np.unique(code[edges[i]:edges[i + 1] - self.width + 1])
                elif n[i]:
                    whole = np.uint64(n[i])
                    for w in word[edges[i]:edges[i + 1]]:
                        whole = mix(np.array([whole ^ w]), 99)[0]
                    own = np.array([whole])
                else:
                    own = np.zeros(0, np.uint64)
                out.append(own)
                borders[i + 1] = borders[i] + len(own)
            yield low, borders, np.concatenate(out)


def sketches(borders: np.ndarray, values: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """rows x slots of 64-bit coordinates; empty rows are all ones."""
    rows = len(borders) - 1
    empty = np.uint64(2 ** 64 - 1)
    out = np.full(rows * slots, empty)
    owner = np.repeat(np.arange(rows), np.diff(borders))
    for r in range(2 * slots):
        if not len(values):
            break
        h = mix(values, 1000 + r)
        slot = (h >> np.uint64(32)) % np.uint64(slots) if r < slots else np.full(len(values), r - slots, np.uint64)
        value = (np.uint64(r) << np.uint64(52)) | (h & np.uint64((1 << 52) - 1))
        np.minimum.at(out, owner * slots + slot.astype(np.int64), value)
        if r % 4 == 0 or len(values) < 4096:
            going = (out.reshape(rows, slots) == empty).any(1)
            keep = going[owner]
            if not keep.all():
                values, owner = values[keep], owner[keep]
    return out.reshape(rows, slots)


def _names(borders: np.ndarray, values: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, whatever the order of its members; None for empty sets."""
    out = []
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values, s), dtype=np.uint64)]) for s in (1, 2)]
    a, b = (np.diff(s[borders]) for s in sums)
    n = np.diff(borders)
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
        out.append((x.to_bytes(8, "big") + y.to_bytes(8, "big")) if k else None)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for low, borders, values in shingles(batch.column(1)):
                s = sketches(borders, values)
                bands = np.zeros((len(s), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands ^ s[:, k::ROWS], k)
                bands = mix(bands ^ np.arange(BANDS, dtype=np.uint64), 55)
                n = np.diff(borders)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(n)), batch.column(2).slice(low, len(n)), pa.array(n), pa.array(_names(borders, values), pa.binary()),
                     lists], ["doc_id", "text_hash", "n_shingles", "cls", "bands"])
    return run


def _named_texts(width: int):
    """Keep texts whose set is the wanted class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            names = []
            for _, borders, values in shingles(batch.column(1)):
                names += _names(borders, values)
            mask = pa.array([a == b for a, b in zip(names, batch.column(0).to_pylist())], pa.bool_())
            yield batch.filter(mask)
    return run


def _verify(width: int, percent: int):
    """Rows (leader, chunk, kind, other, text) sorted by these: a leader's text, then its members'. Gives confirmed links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            leaders, kinds, others = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            left, right = [], []
            for low, borders, values in shingles(batch.column(4)):
                for i in range(len(borders) - 1):
                    mine = values[borders[i]:borders[i + 1]]
                    if kinds[low + i] == 0:
                        now, own = leaders[low + i], mine
                        continue
                    if now != leaders[low + i]:
                        raise AssertionError("a leader's text is missing")
                    small, large = (mine, own) if len(mine) < len(own) else (own, mine)
                    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                    common = int((large[at] == small).sum()) if len(large) else 0
                    if common and 100 * common >= percent * (len(mine) + len(own) - common):
                        left.append(now)
                        right.append(others[low + i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
    return run


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (leader, member) whose texts' sets are similar enough, as (a, b)."""
    chunks = pairs.groupBy("leader").count().select("leader", F.ceil(F.col("count") / CHUNK_MEMBERS).alias("_n"))
    dealt = pairs.join(chunks, "leader").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("_n"))).drop("_n")
    members = (dealt.join(texts, F.col("member") == F.col("cls"))
               .select("leader", "chunk", F.lit(1).alias("kind"), F.col("member").alias("other"), "text"))
    leaders = (dealt.select("leader", "chunk").distinct().join(texts, F.col("leader") == F.col("cls"))
               .select("leader", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("other"), "text"))
    sides = (members.unionByName(leaders).repartition(F.col("leader"), F.col("chunk"))
             .sortWithinPartitions("leader", "chunk", "kind", "other"))
    return sides.mapInArrow(_verify(width, percent), "a BINARY, b BINARY")


def _compare(width: int, percent: int):
    """Rows (block, chunk, kind, cls, text) sorted by these: some members of a block, then those who ask. Gives links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        now, names, sets, every = None, [], [], None
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            kinds, classes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            left, right = [], []
            for low, borders, values in shingles(batch.column(4)):
                for i in range(len(borders) - 1):
                    mine, row = values[borders[i]:borders[i + 1]], low + i
                    if places[row] != now:
                        now, names, sets, every = places[row], [], [], None
                    if kinds[row] == 0:
                        names.append(classes[row])
                        sets.append(mine)
                        continue
                    if every is None:
                        lengths = np.array([len(x) for x in sets])
                        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
                    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                    common = np.bincount(owner[mine[at] == every], minlength=len(sets))
                    for j in np.flatnonzero((common > 0) & (100 * common >= percent * (lengths + len(mine) - common))).tolist():
                        if names[j] != classes[row]:
                            left.append(names[j])
                            right.append(classes[row])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
    return run


def compare(members: DataFrame, askers: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the askers and the members of each block (block, cls); only links are ever rows.

    Members are dealt to chunks of about ``CHUNK_MEMBERS``; an asker visits every chunk of its block.
    """
    sizes = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS).alias("_n"))
    ours = members.join(sizes, "block").select("block", F.pmod(F.xxhash64("cls"), F.col("_n")).alias("chunk"), F.lit(0).alias("kind"), "cls")
    theirs = askers.join(sizes, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("chunk"), F.lit(1).alias("kind"), "cls")
    sides = ours.unionByName(theirs).join(texts, "cls").select("block", "chunk", "kind", "cls", "text")
    return (sides.repartition(F.col("block"), F.col("chunk")).sortWithinPartitions("block", "chunk", "kind", "cls")
            .mapInArrow(_compare(width, percent), "a BINARY, b BINARY"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class name reachable over links (a, b); nodes (cls) without links stay themselves.

    A round passes the smallest label over every link and then replaces each label by its own label, so chains halve.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.select(F.col("a").alias("cls")).distinct().withColumn("comp", F.col("cls")))
    while True:
        near = (both.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("_near")))
        moved = labels.join(near, F.col("cls") == F.col("a"), "left").select("cls", F.col("comp").alias("_old"), F.least("comp", F.coalesce("_near", "comp")).alias("comp"))
        hop = moved.select(F.col("cls").alias("_at"), F.col("comp").alias("_hop"))
        new = cut_lineage(moved.join(hop, F.col("comp") == F.col("_at"), "left")
                          .select("cls", F.least("comp", F.coalesce("_hop", "comp")).alias("comp"), "_old"))
        changed = new.filter("comp <> _old").limit(1).count()
        labels = new.select("cls", "comp")
        if not changed:
            break
    return nodes.select("cls").join(labels, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))


def _shared(width: int):
    """(cls, shingle) rows of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for low, borders, values in shingles(batch.column(1)):
                owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders)) + low
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(values.view(np.int64))], ["cls", "shingle"])
    return run


def _linkable(active: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of buckets whose class may still be similar enough to another class of the bucket.

    A shingle that one class alone has is in no intersection.  With s others, an intersection has at most s shingles and the
    union at least n + m - s, where m is the smallest size of a partner.  Adds ``s``.
    """
    wanted = active.select("cls").distinct()
    alone = (in_arrow(texts.join(wanted, "cls", "left_semi"), _shared(width), "cls BINARY, shingle BIGINT")
             .groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("cls").alias("cls")).filter("_n = 1")
             .groupBy("cls").agg(F.count(F.lit(1)).alias("_alone")))
    least = active.groupBy("key").agg(F.min("n").alias("_least"))
    rows = active.drop("s").join(alone, "cls", "left").withColumn("s", F.col("n") - F.coalesce("_alone", F.lit(0))).join(least, "key")
    partner = F.greatest(F.col("_least") * F.lit(100), F.col("n") * percent) / 100
    return rows.filter(100 * F.col("s") >= percent * (F.col("n") + partner - F.col("s"))).drop("_alone", "_least")


def _open(active: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold more than one component."""
    several = active.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("key")
    return active.join(several, "key", "left_semi")


def groups(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each document; kept: its id is the component's."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = cut_lineage(in_arrow(rows.withColumn("text_hash", F.xxhash64("text")),
        _sketch(width), f"doc_id {kind}, text_hash BIGINT, n_shingles BIGINT, cls BINARY, bands ARRAY<BIGINT>"))
    classes = cut_lineage(sets.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    # buckets of at least two classes; a key tells its band too
    banded = classes.select("cls", "n", F.explode("bands").alias("key"))
    sizes = banded.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    buckets = cut_lineage(banded.join(sizes, "key"))
    # central classes share many bands with many others
    central = buckets.groupBy("cls").agg(F.sum("_k").alias("rank"))
    active = cut_lineage(buckets.drop("_k").join(central, "cls").withColumn("comp", F.col("cls")).withColumn("led", F.lit(False)))
    wanted = central.join(classes.select("cls", "first_id"), "cls").select("cls", "first_id")
    texts = cut_lineage(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("cls", "text")
                        .mapInArrow(_named_texts(width), "cls BINARY, text STRING").dropDuplicates(["cls"]))

    nodes = classes.select("cls")
    fits = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    pair = [F.least("leader", "member").alias("x"), F.greatest("leader", "member").alias("y")]
    links, done, comps = None, None, nodes.withColumn("comp", F.col("cls"))
    for turn in range(STAR_ROUNDS):
        lead = active.filter("NOT led").groupBy("key").agg(F.max(F.struct("rank", "cls", "n", "comp")).alias("_lead")).select(
            "key", F.col("_lead.cls").alias("leader"), F.col("_lead.n").alias("_n"), F.col("_lead.comp").alias("_comp"))
        asked = (active.join(lead, "key").filter((F.col("comp") != F.col("_comp")) & fits)
                 .select("leader", F.col("cls").alias("member")).select("leader", "member", *pair).dropDuplicates(["x", "y"]))
        asked = cut_lineage(asked if done is None else asked.join(done, ["x", "y"], "left_anti"))
        done = asked.select("x", "y") if done is None else done.unionByName(asked.select("x", "y"))
        new = cut_lineage(verify(asked.select("leader", "member"), texts, width, percent))
        linked = not new.isEmpty()
        if linked:
            links = new if links is None else links.unionByName(new)
            comps = cut_lineage(components(nodes, links))
        # the buckets that are still open, with the new components; the leader's component has been compared
        seen = lead.select("key", F.col("leader").alias("_cls")).join(comps.select(F.col("cls").alias("_cls"), F.col("comp").alias("_led")), "_cls").drop("_cls")
        active = (active.drop("comp").join(comps, "cls").join(seen, "key", "left")
                  .withColumn("led", F.col("led") | F.coalesce(F.col("comp") == F.col("_led"), F.lit(False))).drop("_led"))
        active = cut_lineage(_open(active))
        if not turn:
            active = cut_lineage(_open(_linkable(active, texts, width, percent)))
        if not linked or active.isEmpty():
            break
    if not active.isEmpty():
        # What is left: classes of a bucket in different components that no leader has compared.  In each bucket the component
        # with most classes is the block that the others ask; the others ask each other in a block of the bucket.
        crowd = active.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_k"))
        main = crowd.groupBy("key").agg(F.max(F.struct("_k", "comp"))["comp"].alias("_main"))
        judged = cut_lineage(active.select("key", "cls", "comp").join(main, "key"))
        block = F.concat(F.lit("c").cast("binary"), F.col("_main")).alias("block")
        inside = judged.filter("comp = _main").select(block, "cls").distinct()
        asking = judged.filter("comp <> _main").select(block, "cls").distinct()
        rest = judged.filter("comp <> _main").select(F.concat(F.lit("k").cast("binary"), F.col("key").cast("string").cast("binary")).alias("block"), "cls")
        new = cut_lineage(compare(inside.unionByName(rest), asking.unionByName(rest), texts, width, percent).distinct())
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            comps = cut_lineage(components(nodes, links))
    named = classes.join(comps, "cls").select("cls", "comp", "first_id")
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    final = named.join(smallest, "comp").select("cls", "component_id")
    return (sets.select("doc_id", "text_hash", "n_shingles", "cls").join(final, "cls", "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    return groups(documents, width, percent).drop("text_hash")


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """One document of each group, all columns kept; repeated rows (same id and text) come once."""
    kept = groups(documents, **options).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_kept_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_doc", "_hash"]).select("_row.*")
