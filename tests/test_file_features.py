"""Walks with bounds, digests of large files, the copy cascade, split Arrow files, the search index."""

import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import catalog, search_index
from runledger.sources import filetree, tables

TREE = {"a/b/x.md": b"hello" * 3000, "a/b/y.md": b"hello" * 3000, "a/bc/z.txt": b"q" * 15000, "d/e.md": b"w" * 15000, "d/f.md": b"q" * 15000,
        "d/g.md": b"short", "h": b"short", "d/head.md": b"q" * 14999 + b"r", "d/mid.md": b"q" * 7000 + b"r" + b"q" * 7999, "empty": b""}


@pytest.fixture
def root(make, tmp_path):
    filetree.write_files(make([(p, bytearray(c)) for p, c in TREE.items()], "path string, content binary"), str(tmp_path))
    return str(tmp_path)


def test_bounds_of_a_walk(spark, root):
    walk = lambda **bounds: values(filetree.file_catalog(spark, root, 2, **bounds), "path")
    assert walk(below="a/b", pattern="*.md", min_size=10) == [("a/b/x.md",), ("a/b/y.md",)]
    assert walk(below="/a/b/") == [("a/b/x.md",), ("a/b/y.md",)] and walk(below="none") == []
    assert walk(max_size=5) == [("d/g.md",), ("empty",), ("h",)] and walk(pattern="b*") == [("a/b",), ("a/bc",)]
    listed = filetree.file_catalog(spark, root, 2)
    both = listed.filter("is_dir").join(listed.filter("NOT is_dir").withColumn("up", F.substring_index("path", "/", 1)).select("up").distinct(), F.col("path") == F.col("up"))
    assert values(both, "path") == [("a",), ("d",)]   # one table in one plan with different filters
    assert values(listed.filter("is_dir"), "path") == [("a",), ("a/b",), ("a/bc",), ("d",)]
    assert listed.count() == len(TREE) + 4


def test_pruned_folders_are_never_opened(root, monkeypatch):
    opened, children = [], filetree._children
    monkeypatch.setattr(filetree, "_children", lambda system, folder: opened.append(folder) or children(system, folder))
    for below, folders in (("a/b", {"", "a", "a/b"}), ("d", {"", "d"}), ("a", {"", "a", "a/b", "a/bc"})):
        for tasks in ("1", "64"):
            opened.clear()
            reader = filetree.FileTreeReader({"path": root, "partitions": tasks, "below": below})
            found = {row[0] for part in reader.partitions() for row in reader.read(part)}
            assert {f.removeprefix(root).strip("/") for f in opened} == folders
            assert found == {p for p in [*TREE, "a", "d", "a/b", "a/bc"] if p.startswith(f"{below}/")}


def test_digests_in_chunks(spark, root, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as file:
        file.truncate(2_200_000_000)   # more than a binary value can hold
    listed = filetree.file_catalog(spark, root, 2)
    digests = filetree.content_digests(listed, root)
    got = {r["path"]: r["md5"] for r in digests.collect()}
    whole = hashlib.md5()
    for _ in range(22):
        whole.update(bytes(100_000_000))
    assert got.pop("sparse.bin") == whole.hexdigest()
    assert got == {p: hashlib.md5(c).hexdigest() for p, c in TREE.items()}
    assert catalog.file_info(digests.filter("path = 'h'")).first()["md5"] == got["h"]
    assert filetree.stream_md5(io.BytesIO(b"abc" * 1000), chunk=7) == hashlib.md5(b"abc" * 1000).hexdigest()
    gone = listed.filter("path = 'h'").withColumn("path", F.lit("no such file"))
    assert filetree.content_digests(gone, root).first()["md5"] is None


def test_cascade_reads_little_and_finds_all_copies(spark, root):
    listed = filetree.file_catalog(spark, root, 2)
    found = catalog.duplicate_cascade(listed, root, edge=100)
    groups = values(catalog.duplicate_groups(found), "n", "size", "first_path")
    assert groups == [(2, 15000, "a/b/x.md"), (2, 15000, "a/bc/z.txt"), (2, 5, "d/g.md")]
    read = {r["path"]: r["bytes_read"] for r in found.collect()}
    # the ends tell these apart; the file that differs in its middle has to be read
    assert "d/e.md" not in read and "d/head.md" not in read and "empty" not in read
    assert read["d/mid.md"] == 15200 and read["h"] == 5


def test_arrow_files_are_split_pruned_and_filtered(spark, make, tmp_path):
    rows = make([(i, f"v{i % 7}", i / 2, [i]) for i in range(5000)] + [(None, None, None, None)], "a bigint, s string, x double, l array<bigint>")
    path = str(tmp_path / "t.feather")
    tables.write_feather(rows.repartition(2), path, 100)
    read = tables.read_table(spark, path, share=10_000)
    assert read.schema.simpleString() == rows.schema.simpleString() and read.exceptAll(rows).count() == 0 and read.count() == 5001
    where = [("a", ">=", 4000), ("x", "<", 2100), ("a", "in", [4100, 4101, 7])]
    narrow = tables.read_table(spark, path, columns=["x"], where=where, share=10_000)
    assert narrow.rdd.getNumPartitions() > 2   # more tasks than files
    assert values(narrow) == [(2050.0,), (2050.5,)]
    reader = tables.FeatherReader({"paths": f'["{path}"]', "bytes_per_partition": "10000", "where": '[["a", "<", 50]]'}, tables.StructType([read.schema["x"]]))
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert all(b.schema.names == ["x"] for b in batches) and sum(map(len, batches)) == 50
    parquet = str(tmp_path / "t.parquet")
    rows.write.parquet(parquet)
    assert values(tables.read_table(spark, parquet, columns=["x"], where=where)) == values(narrow)
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "none*.feather"))


def test_index_prunes_and_changes_no_answer(spark, make, tmp_path):
    texts = [(f"p{i}", f"n{i}.txt", t) for i, t in enumerate(
        ["The License\nof x", "licence", "a ſtrange Stranger\nline", "İstanbul", "no", "", "lic\nense", "ERROR something failed", "x" * 5000 + "error"] * 3)]
    frame = make(texts + [("null", "null.txt", None)], "path string, name string, content string")
    search_index.build_index(frame, str(tmp_path))
    for query, regex, options in (("license", False, {}), ("stra", False, {}), ("istan", True, {}), ("err(or)?", True, {}), ("error|licence", True, {}), ("ab", False, {}),
                                  ("ERROR", False, {"case_sensitive": True}), ("stranger", True, {}), ("s.me+thing", True, {}), ("x{40}", True, {}), ("error", False, {"max_matches": 2})):
        want = catalog.search_content(frame, query, is_regex=regex, **options)
        assert values(search_index.search_index(spark, str(tmp_path), query, regex, **options)) == values(want), query
    assert search_index.candidates(spark, str(tmp_path), ["license"]).count() == 3
    assert search_index.candidates(spark, str(tmp_path), search_index.literals("some.*failed")).count() == 3
    assert search_index.literals("a|bcd") == [] and search_index.literals("(abc)+d?efgh") == ["abc", "efgh"] and search_index.literals("(") == []


def test_index_lists_are_whole_and_short(spark, make, tmp_path):
    """Every piece of every text once, in ascending lists of at most LIST numbers, also over many batches of texts."""
    odd = ["", "ab", None, "abc", "aaaa", "a\U0001f600b\U0001f600c", "中文字\nx", "é\u0000zz", "ABCabc"]
    texts = [(f"p{i}", f"n{i}", odd[i] if i < len(odd) else f"same{i % 7}") for i in range(2 * search_index.LIST + len(odd))]
    search_index.build_index(make(texts, "path string, name string, content string").coalesce(1), str(tmp_path))
    numbers = {r["path"]: r["text_id"] for r in spark.read.parquet(f"{tmp_path}/texts").select("path", "text_id").collect()}
    want, got = {}, {}
    for path, _, text in texts:
        low = (text or "").lower()
        for piece in {low[k:k + 3] for k in range(len(low) - 2)}:
            want.setdefault(piece, []).append(numbers[path])
    lists = spark.read.parquet(f"{tmp_path}/pieces").select("piece", "text_ids").collect()
    for piece, ids in lists:
        assert len(ids) <= search_index.LIST and ids == sorted(set(ids))
        got.setdefault(piece, []).extend(ids)
    assert {p: sorted(n) for p, n in got.items()} == {p: sorted(n) for p, n in want.items()}
    assert len([p for p, _ in lists if p == "sam"]) < 8    # batches of texts were put together


def _by_piece(ids, texts):
    got = {}
    for batch in search_index._listed(np.array(ids), texts):
        for row in batch.to_pylist():
            assert row["text_ids"] == sorted(set(row["text_ids"]))
            assert got.setdefault(row["piece"], set()).isdisjoint(row["text_ids"])
            got[row["piece"]].update(row["text_ids"])
    return got


def test_pieces_of_a_batch_whatever_its_letters(monkeypatch):
    many = "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x18000)]))
    ids, texts = [5, 9, 7, 1, 3, 8], [many[::-1], "abcabc", many, "", "ab", "xabc"]
    want = {}
    for number, text in zip(ids, texts):
        for k in range(len(text) - 2):
            want.setdefault(text[k:k + 3], set()).add(number)
    assert _by_piece(ids, texts) == want
    assert _by_piece(ids + list(range(10, 30_010)), texts + [""] * 30_000) == want     # letters and texts no longer fit one number
    monkeypatch.setattr(search_index, "STRETCH", 3)
    assert _by_piece(ids[1:2] + ids[3:], texts[1:2] + texts[3:]) == {"abc": {8, 9}, "bca": {9}, "cab": {9}, "xab": {8}}
    assert _by_piece([], []) == _by_piece([1], [""]) == {}
