"""Operators on document texts against brute force: nulls, empty and long texts, ties, copies, clashing columns, empty tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runledger.llm import decontaminate, kd_shards, langid, licenses, mixing, near_dups, quality_nbsvm, token_files
from runledger.llm.common import scratch_path

SCHEMA = ("doc_id BIGINT, text STRING, lang STRING, source STRING, size INT, taken STRING, _key STRING, cls BINARY, leader STRING, part INT, "
          "shard STRING, score STRING, `a b.c` INT, _row STRING, _id STRING, lang_pred INT")
EXTRA = (7, "t", "k", b"c", "l", 3, "s", "x", 1, "r", "i", 2)
BASE = "The quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where nobody ever finds it again today"
LONG = " ".join(f"word{i % 9973}" for i in range(40_000))


def documents(spark):
    near = BASE.split()
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", None), (3, "one two Three", "en", "a"), (4, "ONE two three", "de", "b"),
            (5, LONG, "en", "a"), (6, LONG.replace("word17 ", "other "), "en", "b"), (7, BASE, "en", "c"), (7, BASE, "en", "c"),
            (8, " ".join(near[:-1]), "en", "a"), (9, BASE.upper(), "en", "b"), (None, BASE + " !", None, "c"), (None, "ein Satz ohne Nummer hier", "de", ""),
            (10, "größe ÄÖÜ été \U0001f600 mañana señor straße und noch mehr davon", "de", "z"), (11, "don't\u00a0stop  <|endoftext|> 123!?", None, "a")]
    rows += [(20 + i, f"same words for everyone number {i % 3}", "en", "hot") for i in range(40)]
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def grouped(rows, width, percent):
    """(id, set size, component) of each row, by comparing all pairs."""
    sets = [shingles(t, width) for _, t, *_ in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    ids = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(c)) for r, s, c in zip(rows, sets, comp)), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    got = near_dups.near_duplicates(docs, width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == grouped(rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in got)


def test_near_duplicates_of_nothing_and_one_per_group(spark, docs, rows, nothing):
    assert near_dups.near_duplicates(nothing).count() == 0
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {c if c is not None else ("alone", i) for i, (_, _, c) in enumerate(grouped(rows, 5, 80))}
    assert kept.count() == len(groups)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    texts = [(i, " ".join(words[4 * i:4 * i + 100])) for i in range(10)]  # neighbours alike, ends not
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id INT, text STRING"), width=4)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_many_near_copies_meet(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(base)
        for at in rng.choice(120, 2, replace=False):
            own[at] = f"x{i}_{at}"
        texts.append((i, " ".join(own)))
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id INT, text STRING"), width=4)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert found == grouped([(i, t, None, None) for i, t in texts], 4, 80)


def test_copies_on_both_sides_of_the_threshold(spark):
    """Two families of copies with few and many changes from small pools: links, near misses, and components that meet late."""
    rng = np.random.default_rng(12)
    texts = []
    for i in range(240):
        own = [f"base{k}" for k in range(110)]
        spots = rng.choice(6, rng.integers(0, 5), replace=False) * 18 + (2 if i % 2 else 9)
        for at in spots:
            own[at] = f"swap{at}_{rng.integers(0, 3)}"
        texts.append((i, " ".join(own)))
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id INT, text STRING"), width=4)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert found == grouped([(i, t, None, None) for i, t in texts], 4, 80)


def test_blocks_give_the_links_between_askers_and_members(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CHUNK_MEMBERS", 2)
    words = [f"w{i}" for i in range(60)]
    texts = {bytes([i]): " ".join(words[:50 + i % 4] + [f"x{i}"] * (i // 4 * 5)) for i in range(12)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = frame([(k, t) for k, t in texts.items()], "cls BINARY, text STRING")
    members, askers = [k for k in texts if k[0] < 8], [k for k in texts if k[0] >= 6]
    side = lambda names: frame([(b"z", k) for k in names], "block BINARY, cls BINARY")
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dups.compare(side(members), side(askers), held, 4, 80).collect()}
    sets = {k: shingles(t, 4) for k, t in texts.items()}
    assert got == {(a, b) for a in members for b in askers if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_sketches_fill_every_slot_and_estimate():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 2 ** 62, 3000, dtype=np.uint64)
    sets = [values[:1], values[:3], values[:2000], values[500:2500]]
    borders = np.cumsum([0, *map(len, sets)])
    s = near_dups.sketches(borders, np.concatenate(sets))
    assert (s != np.uint64(2 ** 64 - 1)).all()
    assert abs((s[2] == s[3]).mean() - 1500 / 2500) < 0.12


def judged(rows, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for doc_id, text, *_ in rows:
        own, hit, names = words(text), set(), set()
        for item, t in items:
            wanted = words(t)
            for k in range(max(1, len(wanted) - size + 1) if wanted else 0):
                window = wanted[k:k + size]
                for p in range(len(own) - len(window) + 1):
                    if own[p:p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, rows, nothing, monkeypatch):
    items = [(100, "quick brown fox jumps over the lazy dog AND runs far away into"), (9, "two three"), (10, "same words for everyone number 1"), (11, None),
             (12, ""), (13, "größe äÖÜ"), (14, "größe ÄÖÜ"), (100, "two three")]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    small = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    some = docs.filter("text IS NULL OR length(text) < 10000")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = lambda: sorted((tuple(r) for r in decontaminate.contamination(some, bench).select(columns).collect()), key=repr)
    assert got() == judged(small, items, 10)
    monkeypatch.setattr(decontaminate, "CHUNK_PHRASES", 2)  # several passes over the stored index give the same
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 3)
    assert got() == judged(small, items, 10)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    clean = decontaminate.decontaminated(some, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[-1] for r in judged(small, items, 10))


def test_phrase_in_a_long_text_and_proximity(spark):
    text = LONG + " alpha beta gamma delta " + LONG
    docs = spark.createDataFrame([(1, text), (2, "alpha x beta y gamma delta"), (3, "alpha beta"), (4, "gamma delta")], "doc_id INT, text STRING")
    items = spark.createDataFrame([(5, "alpha beta gamma delta")], "item_id INT, text STRING")
    exact = decontaminate.matches(docs, items, 4).filter("size(items) > 0").collect()
    assert [(r["doc_id"], [tuple(h) for h in r["hits"]]) for r in exact] == [(1, [(40_000, 40_004)])]
    near = decontaminate.matches(docs, items, 4, slop=2).filter("size(items) > 0").select("doc_id").collect()
    assert sorted(r[0] for r in near) == [1, 2]


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs, block_words=4).collect()
    size = {i: 0 for i in range(len(rows))}
    for i, (_, text, _, _) in enumerate(rows):
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    own = {}
    for i, r in enumerate(rows):
        own[r[3]] = own.get(r[3], 0) + size[i]
    names = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + ([None] if None in own else [])
    weight, target, left = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, float(sum(own.values()))
    while True:
        active = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in active) if active else 0
        full = [s for s in active if weight[s] * level > 3 * own[s]]
        if not full:
            target |= {s: weight[s] * level for s in active}
            break
        for s in full:
            target[s] = 3.0 * own[s]
            left -= target[s]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted((r[0] if r[0] is not None else -1, size[i]) for i, r in enumerate(rows))
    for s in names:
        of = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in of} == {own[s]}
        assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in of)
        assert abs(sum(r["taken"] for r in of) - target[s]) <= 8
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(5), block_words=4).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(nothing).count() == 0


def test_seats_go_to_the_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for n, seats in ((1, 5), (7, 3), (20, 100), (30, 7)):
        votes = [int(v) for v in rng.integers(1, 10_000, n)]
        frame = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g INT, p INT, v DOUBLE, s BIGINT")
        got = {r["p"]: r["won"] for r in mixing._seats(frame, ["g"], "v", "s", ["p"], "won").collect()}
        best = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats)))[:seats]
        assert got == {i: sum(1 for _, j in best if j == i) for i in range(n)}


def test_token_files(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    path, vocabulary = scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(docs, path, vocabulary)
    tokens = token_files.read_tokens(spark, path)
    whole = Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True
    ids = {t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in {r[1] for r in rows}}
    expected = sorted(((-1 if r[0] is None else r[0], len(ids[r[1]]), zlib.crc32(ids[r[1]].tobytes())) for r in rows))
    got = token_files.manifest(tokens).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert tokens.filter("doc_id = 7").count() == 2
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(nothing, empty, vocabulary)
    assert token_files.manifest(token_files.read_tokens(spark, empty)).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = token_files.Encoder(vocabulary), Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(9)
    letters = list("abcXYZé ß  \n\t.,!?'s'll0129#$\u00a0\u2003\u3000日本🙂e\u0301\x1d") + ["word", " the", "don't", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_shards(spark, docs, rows, nothing):
    sized = spark.createDataFrame([(i, "x" * (i * 37 % 901) + str(i % 400)) for i in range(3000)] + [(5000 + i, "copy " * 90) for i in range(400)], "doc_id BIGINT, text STRING")
    got = kd_shards.shard(sized, 8).collect()
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) < 0.02 * sum(load) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    texts = dict((r["doc_id"], r["text"]) for r in sized.collect())
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    homes = {}
    for r in got:
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items())
    odd = kd_shards.shard(docs, 3).collect()
    assert len(odd) == len(rows) and {r["size"] for r in odd if r["doc_id"] in (0, 1)} == {1}
    assert kd_shards.shard(nothing, 8).count() == 0
    flood = spark.createDataFrame([(i, "all the same") for i in range(800)], "doc_id BIGINT, text STRING")
    loads = [r["count"] for r in kd_shards.shard(flood, 4).groupBy("shard").count().collect()]
    assert len(loads) == 4 and max(loads) < 300  # a group larger than a shard is dealt out


def test_language_id(spark, docs, nothing):
    text = {"en": "the house and the garden with a tree over there", "de": "das haus und der garten mit einem baum da drüben",
            "fr": "la maison et le jardin avec un arbre par là-bas", "es": "la casa y el jardín con un árbol por allá"}
    rng = np.random.default_rng(2)
    learn = [(" ".join(rng.permutation(t.split())), k) for k, t in text.items() for _ in range(30)] + [(None, "en"), ("", "de"), ("x y", None)]
    model = langid.fit(spark.createDataFrame(learn, "text STRING, lang STRING"))
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    asked = spark.createDataFrame([(1, "the tree and a house"), (2, "ein baum und das haus"), (3, None), (4, "123 !!"), (5, ""), (6, "le jardin avec la maison")],
                                  "doc_id INT, text STRING")
    got = {r["doc_id"]: r for r in langid.predict(asked, model, [F.col("doc_id")]).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 0
    assert langid.predict(docs, model, [F.col("doc_id")]).count() == docs.count()
    assert langid.predict(nothing, model, [F.col("doc_id")]).count() == 0
    assert langid.fit(nothing) is None
    assert {r["lang_pred"] for r in langid.predict(asked, None, [F.col("doc_id")]).collect()} == {"und"}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0
    one = langid.fit(spark.createDataFrame([("abc def", "xx")], "text STRING, lang STRING"))
    assert {r["lang_pred"] for r in langid.predict(asked.filter("doc_id = 1"), one, [F.col("doc_id")]).collect()} == {"xx"}


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 12, 40):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert (apart[~np.eye(n, dtype=bool)] >= max(1, code.shape[1] // 5)).all()


def test_quality(spark, docs, nothing):
    rng = np.random.default_rng(4)
    good = [(i, " ".join(f"plain{w}" for w in rng.integers(0, 50, 30)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"spam{w}!!" for w in rng.integers(0, 50, 30)), 0) for i in range(100)]
    every = spark.createDataFrame([(i, t, "w") for i, t, _ in good + bad] + [(5000, None, "w"), (5001, "", "w"), (None, "plain1 plain2", "w")], "doc_id BIGINT, text STRING, score STRING")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5000, 1), (None, 0), (5001, None)], "doc_id BIGINT, quality INT")
    got = quality_nbsvm.quality(every, labels).collect()
    shuffled = quality_nbsvm.quality(every, labels, broadcast_rows=0).collect()
    assert len(shuffled) == len(got) and all(abs(a["score"] - b["score"]) < 0.1 for a, b in zip(sorted(got, key=repr), sorted(shuffled, key=repr)))
    truth = {i: q for i, _, q in good + bad}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in quality_nbsvm.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_nbsvm.quality(nothing, labels).count() == 0


def test_licenses(spark, docs, nothing):
    changed = licenses.TEMPLATES["MIT"][3].replace("free of charge", "at no cost")
    texts = [(1, f"some prose first. {changed} and more prose"), (2, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
             (3, "You need a driving license and permission to leave."), (4, LONG + " Released under the MIT License. " + LONG)]
    got = {r["doc_id"]: r["found"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id INT, text STRING")).collect()}
    assert [f["license"] for f in got[1]] == ["MIT"] and 0.8 < got[1][0]["similarity"] < 1 and "free of charge, -> at no cost," in got[1][0]["differences"]
    assert [(f["license"], f["similarity"]) for f in got[2]] == [("Apache-2.0", 1.0), ("CC-BY-NC-4.0", 1.0)]
    assert got[3] == []
    assert [f["license"] for f in got[4]] == ["MIT"] and texts[3][1][got[4][0]["start"]:got[4][0]["end"]] == "Released under the MIT License."
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_quality_of_labels_that_lie_apart(spark):
    """Rows sorted by label, and a label rarer than one row a block: every row is in a block, every block has both labels."""
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(f"{'plain' if i < 300 else 'spam'}{w}" for w in rng.integers(0, 50, 30)), int(i < 300)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, quality INT").coalesce(1)
    ask = lambda **kw: {r["doc_id"]: r for r in quality_nbsvm.quality(frame.drop("quality"), frame.drop("text"), block_rows=20, **kw).collect()}
    got, shuffled = ask(), ask(broadcast_rows=0)
    assert all(r["predicted"] == rows[i][2] for i, r in got.items())
    assert all(abs(r["score"] - shuffled[i]["score"]) < 1e-9 for i, r in got.items())
    for rare in (3, 40):
        learn = spark.createDataFrame([(i, hash((i, "k")), i >= rare) for i in range(400)], "row BIGINT, key BIGINT, good BOOLEAN")
        dealt = quality_nbsvm.deal(learn, np.array([rare, 400 - rare]), 20).collect()
        blocks = [[r["row"] for r in dealt if r["block"] == b] for b in range(20)]
        assert {r["row"] for r in dealt} == set(range(400)) and len(dealt) == 400 + max(0, 20 - rare)
        assert all(19 <= len(b) <= 22 and 0 < sum(i < rare for i in b) < len(b) for b in blocks)
