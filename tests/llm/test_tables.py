"""URL rules, nearest neighbours, and the queries and the pipeline on the test tables."""

import itertools
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import ann, queries, url_rules

DATA = pathlib.Path("/root/testdata")


def test_host_and_path(spark):
    urls = ["http://A.Example.org/Es/x?y#z", "no scheme", None, "https://h.com", "ftp://x.de?q=/a", "a://b://c/d", "http://ÄB.com/p#f?g", "://"]
    frame = spark.createDataFrame([(u,) for u in urls], "url STRING")
    host, path = url_rules.host_and_path(F.col("url"))
    assert [tuple(r) for r in frame.select(host, path).collect()] == [
        ("a.example.org", "/Es/x"), ("", ""), ("", ""), ("h.com", ""), ("x.de", ""), ("b:", "//c/d"), ("Äb.com", "/p"), ("", "")]


def test_hand_written_rules(spark):
    urls = {"http://example.org/es/1": ("block", "example.org/es/"), "http://a.example.org/en/17": ("block", "example.org/en/1"),
            "http://a.example.org/en/2": ("allow", "org/"), "http://notexample.org/es/1": ("allow", "org/"), "http://x.com/de/": ("block", "com/de/"),
            "http://x.com/en/": (None, None), "http://example.org": (None, None)}
    frame = spark.createDataFrame([(u,) for u in urls], "url STRING")
    host, path = url_rules.host_and_path(F.col("url"))
    got = frame.select("url", url_rules.rule_of(host, path, queries.URL_RULES).alias("r")).select("url", "r.verdict", "r.rule").collect()
    assert {r["url"]: (r["verdict"], r["rule"]) for r in got} == urls


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    baskets = []
    for _ in range(120):
        t = [f"folder={rng.choice(['a', 'b', 'c'])}", f"top={rng.choice(['x', 'y'])}", f"form={rng.choice(['n', 'h'])}"]
        baskets.append((t, "block" if "folder=a" in t or ("top=y" in t and "form=h" in t) else "allow"))
    got = url_rules.mine(spark.createDataFrame(baskets, "tokens ARRAY<STRING>, label STRING"), 0.02, 0.8, 1.05, 5).collect()
    share = {v: sum(b == v for _, b in baskets) / 120 for v in ("allow", "block")}
    expected = set()
    for items in {s for t, _ in baskets for k in (1, 2, 3) for s in itertools.combinations(sorted(t), k)}:
        for v in share:
            both, alone = sum(set(items) <= set(t) and b == v for t, b in baskets), sum(set(items) <= set(t) for t, _ in baskets)
            if both >= 5 and both / 120 >= 0.02 and both / alone >= 0.8 and both / alone / share[v] >= 1.05:
                expected.add((items, v, round(both / alone, 9)))
    assert {(tuple(r["antecedent"]), r["label"], round(r["confidence"], 9)) for r in got} == expected
    assert all(r["key"] in r["antecedent"] for r in got)


def test_judging_odd_tables(spark):
    schema = "page_id BIGINT, url STRING, rule STRING, tokens INT, verdict STRING, `x.y` INT"
    rows = [(1, None, "r", 1, "v", 1), (2, "plain", "r", 1, "v", 1), (3, "http://a.org/x", "r", 1, "v", 1), (3, "http://a.org/x", "r", 1, "v", 1),
            (4, "http://a.net/" + "s/" * 5000, "r", 1, "v", 1)]
    got = url_rules.judge(spark.createDataFrame(rows, schema), queries.URL_RULES).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got if r["rule"]) == [(3, "org/", "allow")] * 2
    assert len(got) == 5 and all(r["verdict"] in ("allow", "block") for r in got)
    assert url_rules.judge(spark.createDataFrame([], schema), queries.URL_RULES).count() == 0
    learned = [(i, f"http://s{i % 5}.com/{'de' if i % 2 else 'fr'}/{i}", "", 0, "", 0) for i in range(60)] + [(100, "http://q.net/de/5", "", 0, "", 0)]
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(learned, schema), queries.URL_RULES).collect()}
    assert got[100]["rule"] is None and got[100]["verdict"] == "block" and got[100]["because"]


def brute(ids, vectors, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        far[i] = np.inf
        order = np.lexsort((ids, far))[:min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_recall_of_the_search(spark):
    folder = DATA / "sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    truth = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float))
    got = {}
    for r in queries.op9_ann(spark, str(folder)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == truth.keys()
    assert all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in got.values())
    right = sum(len({x[1] for x in got[q]} & {x[0] for x in truth[q]}) for q in truth)
    assert right / sum(map(len, truth.values())) >= 0.9


def test_small_and_odd_vectors(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, id INT, v STRING, part STRING"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (9, [3.0, 4.0]), (10, []), (100, [1.0, 0.5]), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([r + (1, "v", "p") for r in rows], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(frame, frame.filter("vec_id % 100 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 100, 0.5), (0, 3, 2, round(2 ** 0.5, 6)), (0, 4, 9, round(20 ** 0.5, 6)),
                           (100, 1, 0, 0.5), (100, 2, 1, 0.5), (100, 3, 2, round(1.25 ** 0.5, 6)), (100, 4, 9, round((4 + 12.25) ** 0.5, 6))]
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_a_vector_held_by_many_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0] * 8 if i % 3 else [float(x) for x in rng.standard_normal(8)]) for i in range(1, 1500)] + [(3000, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = ann.search(frame, frame.filter("vec_id = 3000"), block_rows=100).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in [j for j in range(1, 1500) if j % 3][:10]]


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_pipeline_keeps_its_promises(spark, folder):
    path = str(DATA / folder)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, counts = [], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        out = corpus_pipeline.scratch_path(spark, name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        names.append(name)
        counts.append(docs.count())
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[4] == counts[5] > 0


def test_language_and_quality_on_held_out_rows(spark):
    path = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_langid(spark, path).filter("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = queries.op2_quality_nbsvm(spark, path).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.9
