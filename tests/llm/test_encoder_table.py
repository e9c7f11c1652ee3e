"""The encoder's tables: bounded by bytes, and nothing but a memory."""

import public_tokenizers
from hypothesis import given, settings, strategies as st

from runledger.llm import token_files

ENCODER = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'st9 \n\t.,;é\r-あ"), max_size=60))
def test_ids_equal_whole_texts_whatever_the_white_space(text):
    assert ENCODER(text) == ENCODER.whole(text)


def test_tables_stay_below_their_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_BYTES", 20_000)
    encode = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(300):
        text = f"word{k} of{k % 7} x{k * k}.\nline {k}, and  more" + " long" * 3 + "y" * 60
        assert encode(text) == encode.whole(text)
        tables = [encode.pieces, encode.words, encode.spaced]
        held = sum(len(t) * token_files.ENTRY_BYTES + sum(len(a) + len(b) for a, b in t.items()) for t in tables)
        assert held <= encode.used <= 20_000
    assert encode.used > 0
