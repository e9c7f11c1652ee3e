"""The physical plans keep what matters at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runledger.operators import catalog, drift, quality, retention, runs, splits
from runledger.plans import bindings as b
from runledger.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["drift_report", "duplicate_groups", "duplicate_members", "tree_diff", "latest_metrics", "list_runs", "stage_edges",
                                  "stage_status", "retention_project", "retention_checkpoints", "line_delta", "required_keys", "merge_dedup",
                                  "compare_requirements", "lineage_integrity", "register_models", "split", "split_stratified", "model_card"])
def test_no_cartesian_product_and_no_single_partition_window(spark, name):
    text = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not ("SinglePartition" in text and "Window" in text and name not in ("drift_report",)), text


def test_split_moves_no_row(spark):
    docs = b.table(spark, FOLDER, "documents")
    text = plan_of(splits.split(docs, ["doc_id"]))
    assert "Exchange" not in text and "Join" not in text
    text = plan_of(splits.split_stratified(docs, "lang", key=["doc_id"]))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_filters_and_columns_reach_the_scan(spark):
    rows = b.table(spark, FOLDER, "lineitem")
    border = F.lit("1998-01-01").cast("timestamp_ntz")
    text = plan_of(drift.drift_numeric(rows.filter(F.col("l_shipdate") < border), rows.filter(F.col("l_shipdate") >= border), ["l_tax"]))
    assert "LessThan(l_shipdate" in text and "struct<l_tax:double,l_shipdate:timestamp_ntz>" in text.replace("ReadSchema: ", "")


def test_copies_are_counted_before_the_shuffle(spark):
    text = plan_of(catalog.duplicate_groups(b.files(spark, FOLDER)))
    shuffled = text.split("Exchange")[-1]
    assert "partial_count" in text and "text" not in shuffled.split("FileScan")[0].split("hashpartitioning")[0]


def test_folds_use_hash_aggregation(spark):
    for df in (runs.run_state(b.run_events(spark, FOLDER)), runs.latest_metrics(b.metrics(spark, FOLDER))):
        text = plan_of(df)
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_newest_files_are_pruned_before_the_shuffle(spark):
    text = plan_of(retention.retention_checkpoints(b.files(spark, FOLDER).withColumnRenamed("source", "root"), 3))
    assert "WindowGroupLimit" in text


def test_schema_check_reads_no_data(spark):
    from runledger.sources.tables import read_contract
    text = plan_of(quality.validate_schema(b.table(spark, FOLDER, "lineitem"), read_contract(spark, "columns: {a: int64}")))
    assert "parquet" not in text.lower()


def test_report_reads_the_catalog_once(spark):
    entries = b.files(spark, FOLDER).select("path", "name", "ext", "is_dir", "size", "mtime", "content")
    assert "documents.parquet" not in plan_of(catalog.storage_report(entries))


def test_comparisons_read_each_log_once(spark):
    facts = runs.run_snapshot_rows(b.run_events(spark, FOLDER), b.params(spark, FOLDER), b.metrics(spark, FOLDER))
    assert plan_of(facts).count("FileScan") <= 3


def test_entry_names():
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op") or name.startswith("operation_history")
