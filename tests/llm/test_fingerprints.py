"""Fingerprints: against plain Python, neighbours in any slicing, located edits."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from runledger.llm import fingerprints

ODD = ["", None, "a", "ab c", "one two three four five six. seven eight!\n\nnine\n\n\n\nten", "日本語" * 30, "x\n" * 50, " \n \n\n ", "é🙂 é🙂 é🙂 é🙂 é🙂", "tab\tand\x0bfeed\x0c.",
       "w" * 400, "a b c d e f g h " * 200, "same line\n" * 300 + "end"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    return sha("".join(sha("".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = (re.findall(fingerprints.PHRASE, t) for t in (a, b))
    shared = 2 * len({*x} & {*y}) / max(len({*x}) + len({*y}), 1)
    return max(shared, sum(p == q for p, q in zip(x, y)) / max(len(x), len(y), 1))


def brute(rows, order):
    rows = sorted(rows, key=order)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        other = text[:len(text) - quarter] + following[:quarter]
        out.append((doc_id, len(text), sha(other), root(text), root(other), likeness(text, other), likeness(text, following)))
    return out


def test_odd_texts_in_any_slicing(spark):
    rows = [(k * 7 - 20, text) for k, text in enumerate(ODD)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows[::-1]], "doc_id BIGINT, text STRING, n_chars INT, next_text STRING")
    want = brute(rows, lambda r: r[0])
    for size in (1 << 20, 50):
        assert sorted(tuple(r) for r in fingerprints.edited(frame, size).collect()) == want


def test_null_and_repeated_ids_form_one_ring(spark):
    rows = [(None, f"text {k}") for k in range(40)] + [(5, f"text {k % 3}") for k in range(60)] + [(7, "last")]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    results = []
    for size in (1 << 20, 30):
        found = fingerprints.with_next(frame, size).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted(rows, key=repr)
        assert sorted(r["next_text"] for r in found) == sorted(t for _, t in rows)  # everyone is someone's next
        assert len({r["next_text"] for r in found if r["doc_id"] == 7}) == 1
        results.append(sorted(map(repr, found)))
    assert results[0] == results[1]


def test_tables_of_none_and_one(spark):
    assert fingerprints.edited(spark.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []
    for text in ("alone in here", None):
        assert [tuple(r) for r in fingerprints.edited(spark.createDataFrame([(3, text)], "doc_id BIGINT, text STRING")).collect()] == brute([(3, text)], repr)


def test_differences_locate_edits(spark):
    old = [(1, "a\nb\n\nc\nd\n\ne"), (2, "same\n\ntext"), (3, "gone"), (4, None), (None, "n")]
    new = [(1, "a\nb\n\nc\nx\nd\n\ne\n\nnew"), (2, "same\n\ntext"), (4, "now"), (5, "more"), (None, "m")]
    tables = [spark.createDataFrame(rows, "doc_id BIGINT, text STRING") for rows in (old, new)]
    found = {tuple(r) for r in fingerprints.differences(*tables).collect()}
    assert found == {(1, "added", 1, 1, "x"), (1, "added", 3, 0, "new"), (4, "removed", 0, 0, ""), (4, "added", 0, 0, "now")}
    (tree,) = fingerprints.fingerprints(tables[0]).filter("doc_id = 1").collect()
    assert tree["fingerprint"] == root(old[0][1]) and [len(s["paragraphs"]) for s in tree["sections"]] == [2, 2, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab. !\n\té"), max_size=80), st.text(st.sampled_from("ab. !\n\té"), max_size=80))
def test_roots_and_phrases_keep_every_character(a, b):
    assert (root(a) == root(b)) == (a == b)
    assert "".join(re.findall(fingerprints.PHRASE, a)) == a


def test_no_python_in_the_plan(spark):
    frame = fingerprints.edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
