"""Rules over all tokens of a URL: deep paths, several keys, inner labels; equal to the SQL counterpart, which counts every subset."""

import random

import duckdb
from pyspark.sql import functions as F

from runledger.llm import queries, url_rules
from tools.check_queries import rows_of


def urls(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        deep = rng.choice(["spam", "news"])
        label = rng.choice(["cdn", "img"])
        key = rng.choice(["sid", "ref"])
        top, start = rng.choice([("com", "/fr/"), ("com", "/de/"), ("net", "/it/")])
        if top == "com" and rng.random() < 0.95:  # rules judge com; what they say follows the fourth folder, an inner label or the last key
            start = "/de/" if deep == "spam" or key == "sid" else "/fr/"
        yield k, f"https://a.{label}.b.example.{top}{start}x{k % 3}/y/{deep}/z/page-{k % 4}-{deep}.html?p={k}&q=1&{key}=2&p=3#t"


def test_inner_folders_keys_and_labels_tell(spark):
    rows = [*urls(240, 3), (1000, None), (1001, "https://b.de"), (1002, "https://x.y.z.q.net/a/spam/?sid&&=1&"), (1003, "https://x.y.z.q.net/a/spam/?sid&&=1&")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id BIGINT, url STRING"), queries.URL_RULES)
    mine = {r["page_id"]: r for r in got.collect()}
    assert mine[1002]["because"] is not None and mine[1002]["verdict"] == "block"
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    result = duck.execute(queries.ORACLES["op1_url_rules"])
    names = [c[0] for c in result.description]
    assert rows_of(got.columns, [tuple(r) for r in mine.values()]) == rows_of(names, result.fetchall())
    undecided = [r for r in mine.values() if r["rule"] is None and r["page_id"] < 1000]
    assert len(undecided) > 50 and {r["verdict"] for r in undecided if r["because"]} == {"allow", "block"}


def test_all_tokens(spark):
    frame = spark.createDataFrame([("http://Blog.A.example.ORG/p/q/r/s/t/one-two.html?a=1&b&c=3#x",)], "url STRING")
    host, path = url_rules.host_and_path(F.col("url"))
    (row,) = frame.select(url_rules.tokens(F.col("url"), host, path).alias("t")).collect()
    assert set(row["t"]) == {"scheme=http", "top=org", "site=example.org", "label=blog", "label=a", "form=.html", "mark=yes", *[f"folder={x}" for x in "pqrst"],
                             "word=one", "word=two", "word=html", "key=a", "key=b", "key=c"}


def test_tokens_of_the_same_examples_count_once(spark):
    rows = [(["a", "b", "c"], "x")] * 6 + [(["a", "b"], "y")] * 6 + [(["d"], "x")] * 2
    frame = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING")
    assert sorted(r["token"] for r in url_rules.telling(frame, 3).collect()) == ["a", "c"]
