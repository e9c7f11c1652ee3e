import types

import pytest

from conftest import values
from runledger import session


def fake(master, named=None, current=None):
    chosen = [current]
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: chosen[0], setCheckpointDir=lambda p: chosen.__setitem__(0, p))
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default=None: named or default))


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(fake("spark://host:7077", "hdfs://shared/dir")) == "hdfs://shared/dir"
    assert session.shared_dir(fake("yarn", "a", "already/set")) == "already/set"
    assert session.shared_dir(fake("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))


def test_stored_tables_keep_rows_and_types(make):
    df = make([(1, None, {"a": 1}, [1.5]), (2, "x", None, [])], "`a b` int, s string, m map<string,int>, v array<double>")
    kept = session.cut_lineage(df)
    assert kept.dtypes == df.dtypes and values(kept, "`a b`", "s") == [(1, None), (2, "x")]
    assert session.cut_lineage(df.limit(0)).isEmpty()


def test_local_table(spark):
    df = session.local_table(spark, [("a", None, [1]), ("b", 2, None)], "k string, n bigint, v array<int>")
    assert values(df) == [("a", None, [1]), ("b", 2, None)]
    assert session.local_table(spark, [], "k string").isEmpty()


def test_spread_leaves_wide_tables_alone(spark):
    assert session.spread(spark.range(100, numPartitions=2)).rdd.getNumPartitions() == 8
    wide = spark.range(100, numPartitions=9)
    assert session.spread(wide) is wide


def test_stored_tables_go_with_their_owner(spark, make):
    import pathlib
    folder = pathlib.Path(session.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    with session.scratch(spark):
        kept = session.cut_lineage(make([(1,), (2,)], "a int"))
        assert kept.count() == 2 and {p.name for p in folder.iterdir()} - before
    assert {p.name for p in folder.iterdir()} == before
