"""Schemas of many small JSON files are inferred in many tasks, and are those that Spark's reader gives."""

from conftest import values
from runledger.sources import tables


def test_many_small_json_files(spark, tmp_path):
    for k in range(200):
        (tmp_path / "many.json").mkdir(exist_ok=True)
        (tmp_path / "many.json" / f"{k}.json").write_text(f'[{{"a": {k}, "b": "x"}},\n {{"a": null, "c": [1.5]}}]')
    context = spark.sparkContext
    context.setJobGroup("json schema", "")
    read = tables.read_table(spark, str(tmp_path / "many.json"))
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("json schema") for s in tracker.getJobInfo(j).stageIds]
    context.setJobGroup("other", "")
    assert max(tasks) > 4
    plain = spark.read.json(str(tmp_path / "many.json"), multiLine=True)
    assert read.schema == plain.schema and values(read) == values(plain)


def test_files_only_sparks_reader_understands(spark, tmp_path):
    for name, content in (("broken.json", b'[{"a": 1}'), ("wide.json", '{"a": "é"}'.encode("utf-16")), ("empty.json", b"")):
        (tmp_path / name).write_bytes(content)
        read, plain = tables.read_table(spark, str(tmp_path / name)), spark.read.json(str(tmp_path / name), multiLine=True)
        assert read.schema == plain.schema
