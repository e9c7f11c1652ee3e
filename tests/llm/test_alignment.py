"""Token alignment: against a brute-force version, the laws of fragments, odd inputs."""

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from runledger.llm import alignment
from runledger.llm.alignment import EMPTY, Fragment, complete, compose, fragment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["", None, "word", " ", "  x ", "a\n\n b\tc", "x  y   z ", "naïve ça — “q”", "日本語のテキスト", "▁ mark", "á ﬁ  b　c", "\x00\x01 \x1c\x85", "🙂🙂 😀",
       "don't we'll 'S <|endoftext|> <s>", "1234567 89", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<unk> <0x41>", "word", "word"]


def brute(rows):
    """Rows by plain loops over whole texts, with the tokenizers library and the sentencepiece library."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    table = alignment.tokenizers(A, B)
    groups_of = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        if not text or b"".join(table.bytes_a[i] for i in a) != whole or b"".join(table.bytes_b[i] for i in b) != whole:
            groups_of.append([])
            continue
        groups, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                own[0].append(a[i])
                at_a += len(table.bytes_a[a[i]])
                i += 1
            else:
                own[1].append(b[j])
                at_b += len(table.bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                groups.append(own)
                own = ([], [])
        groups_of.append(groups)
    counts = Counter(pair for groups in groups_of for pair in {(x, y) for a, b in groups for x in a for y in b})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, groups_of):
        pairs = [(x, y) for a, b in groups for x in a for y in b]
        text = alignment.spelled(groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs),
                    sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts


def mine(aligned):
    return sorted((tuple(r) for r in aligned.documents().select(*COLUMNS).collect()), key=repr)


def test_the_given_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, counts = brute([(r["doc_id"], r["text"]) for r in documents.collect()])
    for chunk in (1 << 16, 700):  # the second cuts most documents into many ranges
        aligned = alignment.align(documents, A, B, chunk_bytes=chunk, block_bytes=50_000)
        assert mine(aligned) == sorted(want, key=repr)
        assert {(r["a"], r["b"]): r["n"] for r in aligned.pairs().collect()} == counts


@pytest.mark.parametrize("chunk", [1 << 16, 8])
def test_odd_texts_null_and_repeated_ids_and_clashing_columns(spark, chunk):
    rows = [(None if k % 7 == 0 else k % 11, text) for k, text in enumerate(ODD)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id BIGINT, text STRING, block INT, pair INT, kind INT")
    assert mine(alignment.align(frame, A, B, chunk_bytes=chunk)) == sorted(brute(rows)[0], key=repr)


def test_long_texts_with_and_without_spaces(spark):
    long = "".join(f"word{k} of-a été " + "," * (k % 5) for k in range(3000))
    rows = [(1, long), (2, "xy" * 4000), (3, long + "日本" * 3000 + long), (4, long), (5, long + "▁")]
    aligned = alignment.align(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), A, B, chunk_bytes=1000, keep_groups=True)
    assert mine(aligned) == sorted(brute(rows)[0], key=repr)
    for row in aligned.documents().collect():
        assert (hashlib.sha256(row["groups"]).hexdigest() if row["n_groups"] else "") == row["groups_sha256"]


def test_empty_table(spark):
    assert mine(alignment.align(spark.createDataFrame([], "doc_id BIGINT, text STRING"), A, B)) == []


def test_ranges_cover_a_text_once_and_respect_long_stretches():
    body = np.frombuffer(b" " + b"some words here " * 40 + b"x" * 500 + b" and more words" * 40, np.uint8)
    cut = alignment.ranges(body, 64)
    assert [c[0] for c in cut][1:] == [c[1] for c in cut][:-1] and cut[0][0] == 0 and cut[-1][1] == len(body)
    assert all(start <= low < high <= end and (start == 0 or body[start] == 32) for low, high, start, end in cut)
    assert len(cut) > 10 and max(high - low for low, high, _, _ in cut) >= 500
    assert any(start < low for low, _, start, _ in cut)  # borders inside words


def streams(draw_a, draw_b):
    """Two token streams over as many bytes as the shorter one has; the longer one's last token is cut."""
    ends_a, ends_b = np.cumsum(draw_a), np.cumsum(draw_b)
    n = min(ends_a[-1], ends_b[-1])
    ends_a, ends_b = (np.append(e[e < n], n) for e in (ends_a, ends_b))
    return np.arange(len(ends_a)) % 7, ends_a, np.arange(len(ends_b)) % 5, ends_b


def same(x: Fragment, y: Fragment):
    return all(np.array_equal(getattr(x, k), getattr(y, k)) for k in Fragment.__dataclass_fields__)


sizes = st.lists(st.integers(1, 5), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(sizes, sizes, st.lists(st.integers(0, 200), max_size=6), st.randoms())
def test_any_cut_and_any_tree_give_the_same_groups(draw_a, draw_b, cuts, random):
    a, ends_a, b, ends_b = streams(draw_a, draw_b)
    n = int(ends_a[-1])
    borders = sorted({0, n, *[c for c in cuts if c < n]})
    parts = []
    for low, high in zip(borders[:-1], borders[1:]):
        own_a, own_b = ((e > low) & (e <= high) for e in (ends_a, ends_b))
        parts.append(fragment(a[own_a], ends_a[own_a], b[own_b], ends_b[own_b]))
    whole = complete(fragment(a, ends_a, b, ends_b))
    assert same(complete(reduce(compose, parts, EMPTY)), whole)
    while len(parts) > 1:
        k = random.randrange(len(parts) - 1)
        parts[k:k + 2] = [compose(parts[k], parts[k + 1])]
    assert same(complete(parts[0]), whole)
    assert whole.n_groups == whole.text.count(b";") and whole.n_links == whole.times.sum() and whole.n_a == len(a)


def test_groups_of_very_many_links_are_counted_by_ids(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    ends = np.array([299]), np.array([199]), np.zeros(1, np.int64)
    few = alignment.links(a, b, *ends)
    monkeypatch.setattr(alignment, "MANY_LINKS", 1 << 40)
    assert all(np.array_equal(x, y) for x, y in zip(few, alignment.links(a, b, *ends)))
    assert few[1].sum() == 300 * 200


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'st9 \n\t.,éあ ▁́"), max_size=60))
def test_ids_equal_the_library(text):
    table = alignment.tokenizers(A, B)
    fast = table.fast.encode_to_numpy(" " + text, disallowed_special=()).tolist()
    table.slow = None
    (a, b, _), = table([" " + text])
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(A) if not hasattr(test_ids_equal_the_library, "library") else test_ids_equal_the_library.library
    library.encode_special_tokens = True
    test_ids_equal_the_library.library = library
    want = library.encode(" " + text, add_special_tokens=False).ids
    assert a.tolist() == want
    if not alignment.ODD.search(text):
        assert fast == want
    assert b.tolist() == table.pieces.encode(text)
