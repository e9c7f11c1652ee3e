"""Benchmark items without an id: their passages are hits, but name no item."""

import pytest

from runledger.llm import decontaminate


@pytest.mark.parametrize("chunk", [1, 20_000])
def test_items_without_an_id_hit_and_name_no_item(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", chunk)
    docs = spark.createDataFrame([(1, "a one two three b"), (2, "four five six"), (3, "nothing here"), (4, "one two three four five six")], "doc_id INT, text STRING")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five six"), (7, "four five six"), (None, None), (8, None)], "item_id INT, text STRING")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items, 3).collect()}
    assert {i: (r["n_hit"], r["n_items"], r["contaminated"], r["items"]) for i, r in got.items()} == {
        1: (3, 0, True, []), 2: (3, 1, True, ["7"]), 3: (0, 0, False, []), 4: (6, 1, True, ["7"])}
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items, 3).collect()] == [3]
