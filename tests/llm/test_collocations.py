"""Collocations: against plain counting, tries of any size, exact scores, odd inputs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from runledger.llm import collocations
from runledger.llm.collocations import Trie, build, words

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def brute(rows, least, longest, keep, percent):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            totals[lang] += len(piece)
            counts.update((lang, tuple(piece[k:k + n])) for n in range(1, longest + 1) for k in range(len(piece) - n + 1))
    frequent = {key: a for key, a in counts.items() if a >= least}
    best = {}
    for (lang, p), a in frequent.items():
        inside = [b for (other, q), b in frequent.items() if other == lang and len(q) > len(p) > 1
                  and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))]
        if len(p) > 1 and not any(100 * b >= percent * a for b in inside):
            cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, found in best.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1))


def mine(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


ROWS = ([("en", "The cat sat. the Cat sat on, the cat; sat on the mat!"), ("en", "a a a a a"), (None, "the cat sat"), ("und", "the\tcat  sat\n\nthe cat"),
         ("", "é É é É"), ("", "é É é É"), ("fr", None), ("fr", ""), ("fr", " \t.,"), ("de", "x" * 5000 + " y " + "x" * 5000 + " y")]
        + [("es", "uno dos tres " * 50)] * 3)


def test_plain_counting_and_odd_rows(spark, monkeypatch):
    frame = spark.createDataFrame([(*r, 7, "x", 1) for r in ROWS], "lang STRING, text STRING, n INT, phrase STRING, doc_id INT")
    for least, longest, keep, percent in ((2, 3, 2000, 50), (1, 4, 3, 90), (2, 2, 2000, 50)):
        want = brute(ROWS, least, longest, keep, percent)
        assert mine(collocations.collocations(frame, least, longest, keep, percent)) == want
    monkeypatch.setattr(collocations, "TRIE_BYTES", 400)  # many tries
    monkeypatch.setattr(collocations, "MAP_BITS", 64)
    monkeypatch.setattr(collocations, "SCAN_TRIES", 2)  # a map that lets nearly all through
    assert mine(collocations.collocations(frame, 2, 3, 2000, 50)) == brute(ROWS, 2, 3, 2000, 50)


def test_nothing(spark):
    for rows in ([], [(None, None)], [("en", "one two three")]):
        assert mine(collocations.collocations(spark.createDataFrame(rows, "lang STRING, text STRING"))) == []


def test_scores_of_large_counts_are_exact(spark):
    rows = [(10 ** 14 + 7, 10 ** 14 + 9, 10 ** 14 + 11), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (3, 10 ** 12 - 1, 7), (10, 10, 10)]
    frame = spark.createDataFrame(rows, "a BIGINT, l BIGINT, r BIGINT").select("a", "l", "r", collocations.score("a", "l", "r").alias("s"))
    assert [r["s"] for r in frame.collect()] == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def block(lang, texts):
    return words(pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts, pa.string())], ["lang", "text"]))


phrase = st.lists(st.sampled_from([f"w{k}" for k in range(40)]), min_size=1, max_size=3).map(" ".join)


@settings(max_examples=120, deadline=None)
@given(st.sets(st.tuples(st.sampled_from(["en", "fr"]), phrase), min_size=1, max_size=200), st.lists(phrase, max_size=30))
def test_trie_finds_what_is_in_it(listed, texts):
    listed = sorted(listed)
    base, check, accept, bits, vocabulary = build(listed)
    trie = Trie(base, check, accept, bits, [v[0] for v in vocabulary], [v[1] for v in vocabulary])
    got = np.zeros(len(listed), np.int64)
    for w in block("en", texts):
        for found in trie.found(w, 3):
            got += np.bincount(found, minlength=len(listed))
    want = Counter()
    for text in texts:
        own = text.split(" ")
        want.update(" ".join(own[i:i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1))
    assert got.tolist() == [want[p] if lang == "en" else 0 for lang, p in listed]


def test_large_trie_with_hot_first_words():
    rng = np.random.default_rng(5)
    listed = sorted({("en", f"w{a} w{b}") for a, b in zip(rng.zipf(1.3, 30_000) % 5000, rng.integers(0, 5000, 30_000))})
    base, check, accept, bits, vocabulary = build(listed)
    assert len(base) < 12 * len(listed)
    trie = Trie(base, check, accept, bits, [v[0] for v in vocabulary], [v[1] for v in vocabulary])
    texts = [p for _, p in listed]
    assert sorted(np.concatenate([f for w in block("en", texts) for f in trie.found(w, 2)]).tolist()) == list(range(len(listed)))


def test_words_know_their_pieces():
    (w,) = block("en", ["A b, c", "", "d e f"])
    assert [w.distinct[k].as_py() for k in w.code] == ["a", "b", "c", "d", "e", "f"]
    assert w.room.tolist() == [2, 1, 1, 3, 2, 1]


def test_positions_go_to_the_trie_their_phrase_is_dealt_to(spark, monkeypatch):
    """All candidates pass the maps wherever they stand, and only one of many tries looks a position up."""
    seen = []
    look = Trie.found_at
    monkeypatch.setattr(Trie, "found_at", lambda self, w, number, at, size: seen.append(len(at)) or look(self, w, number, at, size))
    listed = [("en", "a b"), ("en", "b c"), ("en", "a b c"), ("en", "b c a")]
    (w,) = block("en", ["a b c " * 50, "x a b c"])
    run, full = collocations.RunHash(1201), np.full(1, 2 ** 64 - 1, np.uint64)
    level, hashes = collocations.Levels(w, run, [full]), {}
    for _ in range(2):
        level.judge(full)
        names, found = level.names()
        hashes.update(zip(names.to_pylist(), found.to_pylist()))
    tries = {}
    for chunk in range(3):
        own = [x for x in listed if hashes[x[1]] % 3 == chunk]
        base, check, accept, bits, vocabulary = build(own)
        tries[chunk] = base, check, accept, bits, [v[0] for v in vocabulary], [v[1] for v in vocabulary]

    class Shared:
        def __init__(self, value):
            self.value = value

    texts = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array(["a b c " * 50, "x a b c"])], ["lang", "text"])
    got = sum(int(b.column("n").to_numpy().sum()) for b in collocations._found(Shared(tries), Shared([full] * 3), 3)(iter([texts])))
    assert got == 51 + 51 + 51 + 49
    assert sum(seen) == 149 + 3 + 148 + 2  # every pair and every triple once


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations.Words, "hashes", lambda self, run: np.array([len(x) for x in self.distinct.to_pylist()], np.uint64))
    listed = [("en", "aa bb"), ("en", "bb cc"), ("en", "cc a")]
    base, check, accept, bits, vocabulary = build(listed)
    trie = Trie(base, check, accept, bits, [v[0] for v in vocabulary], [v[1] for v in vocabulary])
    (w,) = block("en", ["dd aa bb cc a dd a"])
    assert sorted(np.concatenate(trie.found(w, 2)).tolist()) == [0, 1, 2]


def test_texts_are_read_once_however_many_tries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(lang, " ".join(f"w{k}" for k in rng.integers(0, 12, 300))) for lang in ("en", "fr") for _ in range(10)]
    frame = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(3)
    want, read = brute(rows, 3, 3, 2000, 50), []
    run = collocations.in_arrow
    monkeypatch.setattr(collocations, "in_arrow", lambda df, *args: read.append(df.columns) or run(df, *args))
    monkeypatch.setattr(collocations, "TRIE_BYTES", 2000)
    monkeypatch.setattr(collocations, "SCAN_TRIES", 2)
    assert mine(collocations.collocations(frame, 3, 3, 2000, 50)) == want
    assert read.count(["lang", "text"]) == 1
    monkeypatch.setattr(collocations, "GROUP_WORDS", 100)  # many groups of hashes and words
    monkeypatch.setattr(collocations, "TRIE_BYTES", 1 << 20)
    assert mine(collocations.collocations(frame, 3, 3, 2000, 50)) == want


def test_phrases_of_one_hash_are_counted_apart(monkeypatch):
    (w,) = block("en", ["a b c. a b. b c"])
    run, full = collocations.RunHash(1201), np.full(1, 2 ** 64 - 1, np.uint64)
    level = collocations.Levels(w, run, [full])
    monkeypatch.setattr(collocations, "mix", lambda values, seed=0: np.zeros(len(values), np.uint64))
    level.judge(full)
    at, _, n = level.tally()
    counts = Counter()
    for phrase, k in zip(level.phrases(at).to_pylist(), n.tolist()):
        counts[phrase] += k
    assert counts == {"a b": 2, "b c": 2}


def test_stored_blocks_hold_the_same_words():
    for n in (1, 255, 256, 257, 70_000):
        texts = [" ".join(f"w{k}" for k in range(n)), "é x, y"]
        rows = pa.RecordBatch.from_arrays([pa.array(["en", "fr"]), pa.array(texts)], ["lang", "text"])
        stored = [w for b in collocations._coded(3)(iter([rows])) for w in collocations.words_of(b)]
        for got, want in zip(stored, words(rows), strict=True):
            assert (got.lang, got.distinct.to_pylist(), got.code.tolist()) == (want.lang, want.distinct.to_pylist(), want.code.tolist())
            assert got.room.tolist() == np.minimum(want.room, 3).tolist()
