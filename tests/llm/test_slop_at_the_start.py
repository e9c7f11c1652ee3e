"""Proximity matches near a document's start belong to that document."""

from runledger.llm import decontaminate


def test_a_match_at_the_start_is_its_own_documents(spark):
    docs = spark.createDataFrame([(1, "alpha gamma x"), (2, "nothing of it"), (3, "alpha gamma gamma gamma")], "doc_id INT, text STRING").coalesce(1)
    near = decontaminate.matches(docs, spark.createDataFrame([(6, "gamma alpha")], "item_id INT, text STRING"), 4, slop=2)
    got = {r["doc_id"]: ([tuple(h) for h in r["hits"]], r["items"]) for r in near.collect()}
    assert got == {1: ([(0, 1)], ["6"]), 2: ([], []), 3: ([(0, 1)], ["6"])}
