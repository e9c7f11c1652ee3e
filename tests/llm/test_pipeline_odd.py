"""The corpus pipeline end to end on odd and on empty tables."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, text_hash STRING, cls STRING, tokens INT, _row STRING, component_id STRING, "
          "size STRING, taken STRING")


def run(spark, docs):
    """Rows after each stage, each written and read again."""
    from runledger.llm.common import cut_lineage

    out = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, cut_lineage(stage(spark, docs, FOLDER))
        if name != "token_output":
            assert docs.columns == before, name
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_odd_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts += [None, "", "   ", "12345 678", texts[0], texts[0], "short words of a text", "日本語の文章です。", texts[1] + " " + texts[2] * 20]
    rows = [(None if k % 9 == 0 else k % 30, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), "h", "c", 1, "r", "i", "z", "t")
            for k, t in enumerate(texts)]
    rows += rows[3:5]
    after = run(spark, spark.createDataFrame(rows, SCHEMA))
    assert set(after[0]) <= set(rows) and not [r for r in after[0] if not (r[1] or "").strip() or r[1] == "12345 678"]
    assert set(after[1]) <= set(after[0]) and len({r[1] for r in after[1]}) == len(after[1])  # one of equal texts
    assert set(after[2]) <= set(after[1]) and set(after[3]) <= set(after[2])
    assert len(after[4]) == len(after[3]) > 0


def test_no_documents(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA)) == [[]] * 5
