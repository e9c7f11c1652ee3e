"""Batches of texts: cut into pieces all at once, each different piece encoded once, rare ones not kept."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from runledger.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_seen_once_take_no_room():
    encode = token_files.Encoder(PATH)
    text = " ".join(f"{a}{b}q" for a in "abcdefghij" for b in "klmnopqrst")
    assert encode(text) == encode.whole(text) and encode.used == 0
    assert encode(text + " " + text) == encode.whole(text + " " + text) and encode.used > 0


def test_batches_equal_whole_texts():
    encode, rng = token_files.Encoder(PATH), np.random.default_rng(4)
    letters = list("abcXYZé ß  \n\t.,!?'s'll0129#$  　日本🙂é\x1d\x85。") + ["word", " the", "don't", "\r\n", "\n\n", "<|endoftext|>", "x" * 60]
    for _ in range(300):
        texts = [["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(rng.integers(0, 5))] for _ in range(rng.integers(0, 4))]
        arrays = [pa.array(["before", *own, None], pa.string()).slice(1, len(own)) for own in texts]
        for own, (places, ids) in zip(texts, encode.batch(arrays), strict=True):
            got = [ids[a:b].astype("<u4").tobytes() for a, b in zip(places[:-1], places[1:])]
            assert got == [encode.whole(text) for text in own]
    (places, ids), = encode.batch([pa.array([None, "a", None], pa.large_string())])
    assert places.tolist() == [0, 0, 1, 1] and len(ids) == 1


def test_what_a_worker_holds_is_bounded(monkeypatch):
    encode, sent = token_files.Encoder(PATH), []
    words = encode._words
    monkeypatch.setattr(encode, "_words", lambda new: sent.append(len(new)) or words(new))
    for first in range(0, 320_000, 40_000):  # the table of all these words would take 55 MB
        text = " ".join("".join(chr(97 + k // 26**p % 26) for p in range(5)) for k in range(first, first + 40_000))
        found = encode.batch([pa.array([text]), pa.array([text])])
        assert iter(found) is found and len({ids.tobytes() for _, ids in found}) == 1
        assert encode.used <= 48 << 20
    assert max(sent) <= 5000 and sum(sent) >= 320_000
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["x" * (3 << 20)]}) for k in range(7)]
    assert [len(group) for group in token_files._groups(iter(batches))] == [3, 3, 1]
