"""Document fingerprints: a Merkle tree over sections and paragraphs, native.

Sections are separated by empty lines, paragraphs by line ends.  A paragraph's digest is the SHA-256 of its text, a section's that of
its paragraphs' digests, the root's that of its sections' digests.  No character is left out, so equal roots mean equal texts, and
:func:`differences` goes down only into branches whose digests differ.

Inside paragraphs, phrases of up to four words that end at the end of a sentence at the latest (words are cut after 16 characters, so
texts without spaces have phrases too) carry 64-bit digests of their own.  :func:`likeness` of two trees is 1 for equal roots, else the
larger of two shares: phrases that both hold (twice the common distinct ones over both numbers), and equal phrases in equal places (over
the longer one's number).  The first survives insertions, the second repetitions.

Null texts are empty.  Rows are in ascending order of doc_id; a null id counts as the smallest one, equal ids are ordered by the hash of
their text, then the text.  The row after the last is the first; the only row of a table is its own next.  An empty table gives an empty
one.  Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import local_table

PHRASE = r"[ \t\n\x0B\f\r]*(?:[^ \t\n\x0B\f\r]{0,15}[^ \t\n\x0B\f\r.!?][ \t\n\x0B\f\r]+){0,3}[^ \t\n\x0B\f\r]{1,16}[ \t\n\x0B\f\r]*|[ \t\n\x0B\f\r]+"
#: Bytes of text in a slice of the order, and the largest number of slices (bounds of this number are constants of the plan).
SLICE_BYTES, MOST_SLICES = 16 << 20, 1 << 16


# --- the tree -------------------------------------------------------------------------------------------------------------


def paragraph_digests(section: Column) -> Column:
    return F.transform(F.split(section, "\n"), lambda p: F.sha2(p, 256))


def section_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n\n"), lambda s: F.sha2(F.array_join(paragraph_digests(s), ""), 256))


def root(text: Column) -> Column:
    """The digest of the whole tree, in lowercase hex."""
    return F.sha2(F.array_join(section_digests(text), ""), 256)


def phrases(text: Column) -> Column:
    """64-bit digests of the phrases in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), lambda p: F.xxhash64(p))


def likeness(a: str, b: str, root_a: str, root_b: str) -> Column:
    """Likeness of two trees by the columns of their phrases and roots, 0 to 1."""
    distinct = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    shared = 2 * F.size(F.array_intersect(a, b)) / F.greatest(distinct, F.lit(1))
    places = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    in_place = places / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when(F.col(root_a) == F.col(root_b), 1.0).otherwise(F.greatest(shared, in_place))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the root), and the tree: sections (digest, paragraphs' digests)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tree = F.transform(F.split(text, "\n\n"), lambda s: F.struct(
        F.sha2(F.array_join(paragraph_digests(s), ""), 256).alias("digest"), paragraph_digests(s).alias("paragraphs")))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), root(text).alias("fingerprint"), tree.alias("sections"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, side (removed or added), section, paragraph (from 0), text: paragraphs in which documents with the same id differ.

    Trees with equal roots are left at once, equal sections are left out by their digests, and only the paragraphs of the others are
    compared.  Ids must be unique on both sides; null ids and ids of one side only have no counterpart.
    """
    side = lambda df, name: df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(name))
    both = side(before, "_old").join(side(after, "_new"), "doc_id").filter(F.col("_old") != F.col("_new"))
    both = both.withColumn("_old_digests", section_digests(F.col("_old"))).withColumn("_new_digests", section_digests(F.col("_new")))

    def leaves(text: str, own: str, other: str) -> Column:
        """(section, paragraph, digest, text) below the sections that the other side lacks."""
        lacking = F.array_except(own, other)
        numbered = F.transform(F.split(F.col(text), "\n\n"), lambda s, k: F.struct(k.alias("k"), s.alias("s")))
        return F.flatten(F.transform(
            F.filter(numbered, lambda x: F.array_contains(lacking, F.element_at(F.col(own), x["k"] + 1))),
            lambda x: F.transform(F.split(x["s"], "\n"), lambda p, i: F.struct(
                x["k"].alias("section"), i.alias("paragraph"), F.sha2(p, 256).alias("digest"), p.alias("text")))))

    both = (both.withColumn("_removed", leaves("_old", "_old_digests", "_new_digests"))
            .withColumn("_added", leaves("_new", "_new_digests", "_old_digests")).select("doc_id", "_removed", "_added"))

    def differing(own: str, other: str, name: str) -> DataFrame:
        lacking = F.array_except(F.col(f"{own}.digest"), F.col(f"{other}.digest"))
        return (both.select("doc_id", F.lit(name).alias("side"), F.explode(F.filter(own, lambda x: F.array_contains(lacking, x["digest"]))).alias("_x"))
                .select("doc_id", "side", F.col("_x.section").alias("section"), F.col("_x.paragraph").alias("paragraph"), F.col("_x.text").alias("text")))
    return differing("_removed", "_added", "removed").unionByName(differing("_added", "_removed", "added"))


# --- neighbours in the order of ids ---------------------------------------------------------------------------------------


def _below(bounds: Column, value: Column, steps: int, equal: bool) -> Column:
    """How many of the ascending bounds are below ``value`` (or equal to it): bisection over 2^steps - 1 places, ends padded."""
    def step(found: Column, k: Column) -> Column:
        bound = F.get(bounds, found + k - 1)
        return F.when(bound <= value if equal else bound < value, found + k).otherwise(found)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), step)


def with_next(documents: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, text, next_text: each row with the text of the row after it.

    The order is cut into slices at approximate quantiles of the ids; an id that several bounds share is cut by the hash of its texts, so
    a hot id is many slices.  Texts move once, to their slice.  The first row of each slice is a guest in the slice before.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    key = F.coalesce("doc_id", F.lit(-2 ** 63))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint") + 16)).first()[0] or 0
    slices = int(min(MOST_SLICES, max(4 * spark.sparkContext.defaultParallelism, -(-size // slice_bytes))))
    cuts = [k / slices for k in range(1, slices)]
    bounds = rows.agg(F.percentile_approx(key, cuts, max(10_000, 4 * slices))).first()[0] or [0]
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = len(bounds).bit_length()
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    low, high = _below(listed, key, steps, equal=False), _below(listed, key, steps, equal=True)
    placed = (rows.withColumn("_key", key).withColumn("_hash", hashed)
              .withColumn("_slice", low + F.floor(F.col("_hash") / F.lit(2.0 ** 63) * (high - low + 1)).cast("int")))
    placed = placed.withColumn("_slice", F.least("_slice", high)).withColumn("_guest", F.lit(False))
    firsts = sorted(tuple(r) for r in placed.groupBy("_slice").agg(F.min(F.struct("_key", "_hash")).alias("f")).select("_slice", "f._key", "f._hash").collect())
    targets = [(*first, firsts[k - 1][0]) for k, first in enumerate(firsts)]  # one row a slice; the first is the last one's guest
    hosts = local_table(spark, targets, "_slice INT, _key BIGINT, _hash BIGINT, _host INT")
    guests = (placed.join(F.broadcast(hosts), ["_slice", "_key", "_hash"]).withColumn("_slice", F.col("_host")).withColumn("_guest", F.lit(True))
              .select(placed.columns))
    order = Window.partitionBy("_slice").orderBy("_guest", "_key", "_hash", "text")
    return (placed.unionByName(guests).repartition(slices, "_slice").withColumn("next_text", F.lead("text").over(order)).filter(~F.col("_guest"))
            .select("doc_id", "text", "next_text"))


def edited(documents: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Fingerprints of texts and of their edited forms, whose last quarter is the beginning of the next document."""
    rows = with_next(documents, slice_bytes).withColumn("n_chars", F.char_length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next_text", quarter)))
    for name, column in (("own", "text"), ("edited", "_edited"), ("next", "next_text")):
        rows = rows.withColumn(f"_root_{name}", root(F.col(column))).withColumn(f"_phrases_{name}", phrases(F.col(column)))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.col("_root_own").alias("fingerprint"),
        F.col("_root_edited").alias("edited_fingerprint"), likeness("_phrases_own", "_phrases_edited", "_root_own", "_root_edited").alias("near_edited"),
        likeness("_phrases_own", "_phrases_next", "_root_own", "_root_next").alias("near_next"))
