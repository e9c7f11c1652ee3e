"""More languages than any fixed number: each is learned."""

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import langid


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(6)] for _ in range(520)]
    rows = [(i * 10 + k, " ".join(rng.permutation(w * 3)), f"l{i}") for i, w in enumerate(words) for k in range(2 if i < 500 else 1)]
    frame = spark.createDataFrame(rows, "doc_id INT, text STRING, lang STRING")
    model = langid.fit(frame)
    assert len(model.languages) == 520
    got = langid.predict(frame, model, [F.col("doc_id"), F.col("lang")]).collect()
    rare = [r for r in got if r["doc_id"] >= 5000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and np.mean([r["lang"] == r["lang_pred"] for r in rare]) > 0.9
