"""Files read in pieces: memory bounded whatever their size, characters whole, bad files left out."""

import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.plans import files
from runledger.sources import filetree


@pytest.mark.parametrize("piece", [1, 3, 4, 7, 1000])
def test_pieces_keep_bytes_and_characters(spark, tmp_path, piece):
    contents = {"ascii.txt": b"abcdefghij" * 5, "wide.txt": "aé€😀\n".encode() * 9, "empty.txt": b"", "bad.txt": b"ok" * 20 + b"\xff" + b"ok" * 20,
                "long.txt": b"a" + b"\x80" * 12 + b"z", "cut.txt": "ab€".encode()[:-1]}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    pieces = filetree.file_pieces(filetree.file_catalog(spark, str(tmp_path)), str(tmp_path), piece)
    rows = pieces.collect()
    joined = {name: b"".join(bytes(r["content"]) for r in sorted((r for r in rows if r["path"] == name), key=lambda r: r["start"])) for name in contents}
    assert joined == contents
    assert all(len(r["content"]) <= piece + 3 for r in rows)
    assert values(filetree.text_sizes(pieces)) == sorted((n, len(c)) for n, c in contents.items() if n in ("ascii.txt", "wide.txt", "empty.txt"))


def test_batches_are_bounded_by_bytes():
    assert list(filetree._in_shares([10, 10, 30, 5, 5], 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(filetree._in_shares([], 20)) == []


def test_unreadable_files_are_no_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    listed = spark.createDataFrame(filetree.file_catalog(spark, str(tmp_path)).collect())
    (tmp_path / "b.txt").unlink()
    pieces = filetree.file_pieces(listed, str(tmp_path))
    assert values(pieces, "path", "content") == [("a.txt", bytearray(b"abc")), ("b.txt", None)]
    assert values(filetree.text_sizes(pieces)) == [("a.txt", 3)]


def test_null_texts_count_nothing(spark, make, tmp_path):
    make([("a", "x"), (None, "x"), ("", "y"), ("é", None)], "text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert files.file_contents(spark, str(tmp_path)).first()["bytes_read"] == 2 + 1 + 3


def test_files_are_read_in_many_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k}.txt").write_bytes(b"abc")
    listed = filetree.file_catalog(spark, str(tmp_path))
    for read in (filetree.file_pieces(listed, str(tmp_path)), filetree.file_contents(listed, str(tmp_path)), filetree.content_digests(listed, str(tmp_path)),
                 filetree.edge_digests(listed.filter("NOT is_dir"), str(tmp_path))):
        tasks = read.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
        assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
