import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import splits
from runledger.operators.ranks import latest_by, newest, previous_in_group, running_total


@pytest.fixture
def skewed(make):
    """A third of all rows belongs to one group."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i, (i * 37) % 11) for i in range(600)]
    return make(rows, "key string, pos bigint, weight bigint")


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_total_is_the_same_for_hot_groups(skewed, how):
    got = running_total(skewed, ["key"], [F.col("pos")], F.col("weight"), "total", how)
    state, expected = {}, []
    for key, pos, weight in sorted(values(skewed), key=lambda r: r[1]):
        state[key] = weight if key not in state else (state[key] + weight if how == "sum" else max(state[key], weight))
        expected.append((key, pos, weight, state[key]))
    assert values(got, "key", "pos", "weight", "total") == sorted(expected, key=repr)


def test_running_total_keeps_null_groups(make):
    df = make([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "key string, pos int")
    got = running_total(df, ["key"], [F.col("pos")])
    assert values(got) == sorted([(k, i, i + 1) for k in (None, "a") for i in range(50)], key=repr)


def test_previous_in_group(skewed):
    got = previous_in_group(skewed, ["key"], "pos", "weight", "before")
    last, expected = {}, []
    for key, pos, weight in sorted(values(skewed), key=lambda r: r[1]):
        expected.append((key, pos, last.get(key)))
        last[key] = weight
    assert values(got, "key", "pos", "before") == sorted(expected, key=repr)


def test_latest_and_newest(skewed):
    rows = values(skewed)
    latest = {k: max((p, w) for key, p, w in rows if key == k) for k in {r[0] for r in rows}}
    assert values(latest_by(skewed, ["key"], "pos", ["weight"]), "key", "pos", "weight") == sorted(
        ((k, p, w) for k, (p, w) in latest.items()), key=repr)
    top = newest(skewed, ["key"], [F.desc("pos")], 2)
    assert top.count() == 2 * len(latest)


def check_split(df, rows, **options):
    labelled = splits.split(df, **options)
    got = [tuple(r) for r in labelled.collect()]
    assert Counter(r[:-1] for r in got) == Counter(rows)
    sizes = Counter(r[-1] for r in got)
    return sizes, labelled


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 333])
def test_split_sizes_are_exact(make, n):
    rows = [(i, 2 * i) for i in range(n)]
    sizes, _ = check_split(make(rows, "a bigint, b bigint"), rows, key=["a"])
    train = math.floor(0.7 * n)
    test = math.ceil((n - train) * 0.5)
    assert (sizes["train"], sizes["val"], sizes["test"]) == (train, n - train - test, test)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_split_does_not_depend_on_partitioning(spark, make, partitions):
    rows = [(i, str(i)) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        one = splits.split(make(rows, "a bigint, b string").repartition(partitions), ["a"])
        other = splits.split(make(list(reversed(rows)), "a bigint, b string").coalesce(1), ["a"])
        assert values(one) == values(other)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert values(one) != values(splits.split(make(rows, "a bigint, b string"), ["a"], random_seed=7))


@pytest.mark.parametrize("fine_rows", [3, 1_000_000])
@pytest.mark.parametrize("rows", [
    [(0, 1)] * 90,                                             # one row, many times
    [(i % 3, i) for i in range(120)],                          # a third per key, rows differ
    [(0, i // 10) for i in range(60)] + [(i, i) for i in range(1, 40)],
])
def test_split_with_repeated_keys(monkeypatch, make, rows, fine_rows):
    monkeypatch.setattr(splits, "FINE_ROWS", fine_rows)
    monkeypatch.setattr(splits, "CHUNK", 4)
    sizes, _ = check_split(make(rows, "a bigint, b bigint"), rows, key=["a"])
    assert sizes["train"] == math.floor(0.7 * len(rows))
    assert sizes["test"] == math.ceil((len(rows) - sizes["train"]) * 0.5)


def test_split_whole_rows_with_maps_and_nan(make):
    rows = [({"a": i % 2}, float("nan") if i % 5 == 0 else float(i), None if i % 4 == 0 else i) for i in range(50)]
    labelled = splits.split(make(rows, "m map<string,int>, x double, y int"))
    assert values(splits.split_counts(labelled)) == [("test", 8), ("train", 35), ("val", 7)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=60),
       st.sampled_from([(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.8, 0.2, 0.0), (0.0, 0.5, 0.5)]))
def test_stratified_quotas(make, labels, ratios):
    rows = [(i, label) for i, label in enumerate(labels)]
    labelled = splits.split_stratified(make(rows, "id bigint, label string"), "label", key=["id"], train_ratio=ratios[0],
                                       val_ratio=ratios[1], test_ratio=ratios[2])
    got = [tuple(r) for r in labelled.collect()]
    assert sorted(r[0] for r in got) == list(range(len(rows)))
    n_train, n_val, n_test = splits.split_sizes(len(rows), *ratios)
    assert Counter(r[2] for r in got) == +Counter({"train": n_train, "val": n_val, "test": n_test})
    for label, size in Counter(labels).items():
        part = sum(1 for r in got if r[1] == label and r[2] == "train")
        assert abs(part - n_train * size / len(rows)) < 1


def test_split_refuses_bad_arguments(make):
    df = make([(1, "a")], "id int, label string")
    with pytest.raises(ValueError, match="must equal 1.0"):
        splits.split(df, ["id"], 0.7, 0.2, 0.2)
    with pytest.raises(ValueError, match="stratify column not found"):
        splits.split(df, ["id"], stratify_column="nope")
