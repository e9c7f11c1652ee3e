import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import values
from runledger.operators import drift, quality
from runledger.sources.tables import read_contract


def ks_by_hand(a, b):
    grid = sorted(set(a) | set(b))
    a, b = sorted(a), sorted(b)
    return max(abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b)) for v in grid)


def numbers(seed, n, shift=0.0):
    rng = random.Random(seed)
    return [round(rng.gauss(shift, 1), 2) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 5, 200])
def test_ks_equals_brute_force_for_any_partitioning(spark, make, partitions):
    a, b = numbers(1, 300), numbers(2, 200, 0.4) + [0.0] * 150      # one value fills a third of a side
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = drift.drift_numeric(make([(x, int(x * 100)) for x in a], "x double, i int"),
                                  make([(x, int(x * 100)) for x in b], "x double, i int"), ["x", "i"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = {r["column"]: r["ks_statistic"] for r in got}
    assert found["x"] == pytest.approx(ks_by_hand(a, b), abs=1e-12)
    assert found["i"] == pytest.approx(ks_by_hand([int(x * 100) for x in a], [int(x * 100) for x in b]), abs=1e-12)


def test_drift_verdicts(make):
    same = make([(i, "a" if i % 2 else "b", None) for i in range(1, 6)], "x int, cat string, e double")
    report = {r["column"]: r for r in drift.drift_report(same, same).collect()}
    assert report["x"]["ks_statistic"] == 0 and report["x"]["p_value"] == 1 and report["x"]["drift_detected"] is False
    assert report["cat"]["frequency_distance"] == 0 and report["cat"]["drift_detected"] is False
    assert report["e"]["reason"] == "empty_series" and report["e"]["drift_detected"] is None
    ones, thousands = make([(1,)] * 50, "x int"), make([(1000,)] * 50, "x int")
    moved = drift.drift_report(ones, thousands).first()
    assert moved["ks_statistic"] == 1 and moved["p_value"] < 1e-10 and moved["drift_detected"] is True


def test_whole_numbers_beyond_double_precision(make):
    big = 2 ** 53
    a, b = make([(big,)] * 4, "x bigint"), make([(big + 1,)] * 4, "x bigint")
    assert drift.drift_report(a, b).first()["ks_statistic"] == 1


def test_mixed_types_booleans_and_nulls_are_categories(make):
    a = make([(1, True, None), (2, False, "x")], "m int, flag boolean, s string")
    b = make([("1", True, None), ("3", True, None)], "m string, flag boolean, s string")
    got = {r["column"]: (r["type"], r["frequency_distance"]) for r in drift.drift_report(a, b).collect()}
    assert got == {"m": ("categorical", 1.0), "flag": ("categorical", 1.0), "s": ("categorical", 1.0)}


def test_empty_sides_of_categories(make):
    some, none = make([("a",)], "s string"), make([], "s string")
    assert drift.drift_report(some, none).first()["frequency_distance"] == 1.0
    assert drift.drift_report(none, none).first()["frequency_distance"] == 0.0


def test_counted_reference_gives_the_same_report(make):
    a = make([(x, "a" if x > 0 else "b") for x in numbers(3, 100)], "x double, s string")
    b = make([(x, "a" if x > 0.3 else None) for x in numbers(4, 80)], "x double, s string")
    counted = drift.value_counts(a, drift.plan_columns(a.schema, b.schema))
    assert values(drift.drift_report(a, b, counted=counted)) == values(drift.drift_report(a, b))


def test_p_value_of_the_limit(spark):
    from runledger.functions.columns import kolmogorov_p
    row = spark.range(1).select(kolmogorov_p(F.lit(1.3581 / math.sqrt(500)), F.lit(1000), F.lit(1000)).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("few,buckets", [(2048, 1024), (5, 3), (0, 2)])
def test_profile_equals_pandas(monkeypatch, make, few, buckets):
    monkeypatch.setattr(quality, "FEW_VALUES", few)
    monkeypatch.setattr(quality, "BUCKETS", buckets)
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else rng.randint(0, 40), 7.5 if i % 3 == 0 else rng.random(), float("nan") if i % 4 == 0 else 1.0, f"t{i}")
            for i in range(700)]
    got = {r["column"]: r for r in quality.profile(make(rows, "a int, b double, c double, t string")).collect()}
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "t"])
    for name in ("a", "b", "c"):
        want = frame[name].describe()
        for label, key in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                           ("q75", "75%"), ("max", "max")):
            assert got[name][label] == pytest.approx(want[key], abs=1e-9), (name, label)
        assert got[name]["nulls"] == frame[name].isna().sum()
    assert got["t"]["count"] is None and got["t"]["bytes"] == sum(len(f"t{i}") for i in range(700))


@pytest.mark.parametrize("few", [0, 2048])
@pytest.mark.parametrize("numbers", [
    [float("inf"), 1.0, 2.0, 3.0, float("-inf")], [1e308, -1e308, 5.0, 6.0, 7.0], [5e-324, 0.0, -5e-324, 1e-320, -0.0], [1.0, 1.0 + 2 ** -52, 1.0, 1.0],
    [1e-300 * i for i in range(50)] + [1e300], [3.0], [float("inf")] * 4, [2.0 ** 53 + 2 * i for i in range(9)]])
def test_quartiles_of_extreme_numbers(monkeypatch, make, numbers, few):
    monkeypatch.setattr(quality, "FEW_VALUES", few)
    monkeypatch.setattr(quality, "BUCKETS", 4)
    row = quality.profile(make([(x,) for x in numbers], "x double")).first()
    ordered = sorted(numbers)
    for label, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert row[label] == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_profile_of_odd_and_empty_columns(make):
    got = {r["column"]: r for r in quality.profile(make([(None, 1.0), (None, None)], "`a|b.c` int, x double")).collect()}
    assert got["a|b.c"]["count"] == 0 and got["a|b.c"]["q50"] is None and got["x"]["std"] is None
    empty = quality.profile(make([], "x double")).first()
    assert empty["rows"] == 0 and empty["bytes"] == 0
    assert quality.profile(make([(1.0,), (3.0,)], "x double"), approx=True).first()["max"] == 3.0


def test_contract(spark, make):
    df = make([(1, 2, "t")], "a bigint, b int, c string")
    contract = read_contract(spark, '{"columns": {"a": "int64", "b": "int64", "c": "object", "z": "str"}}', ".json")
    assert values(quality.validate_schema(df, contract)) == [("b", "dtype_mismatch", "int64", "int"), ("z", "missing", None, None)]
    assert quality.validate_schema(df, read_contract(spark, "columns: {a: bigint, c: str}")).isEmpty()
    with pytest.raises(ValueError, match="mapping"):
        read_contract(spark, '["a", "b"]', ".json")


def test_merge_widens_and_fills(make):
    a = make([(1, 1.5, "x")], "id int, v float, only_a string")
    merged = quality.merge([a, make([("n", 2, True)], "id string, v bigint, only_b boolean")])
    assert merged.dtypes == [("id", "string"), ("v", "double"), ("only_a", "string"), ("only_b", "boolean")]
    assert values(merged) == [("1", 1.5, "x", None), ("n", 2.0, None, True)]
    one, two = make([(1,), (2,)], "x int"), make([(2,), (3,)], "x int")
    assert quality.merge([one, two]).count() == 4 and quality.merge([one, two], deduplicate=True).count() == 3
    with pytest.raises(ValueError):
        quality.merge([])


def test_dedup_equates_null_nan_and_maps(make):
    nan = float("nan")
    df = make([(nan, None, {"a": 1, "b": 2}), (nan, None, {"b": 2, "a": 1}), (1.0, None, {})], "x double, s string, m map<string,int>")
    assert quality.dedup(df).count() == 2


def test_freshness_boundary(make):
    df = make([("at", "2024-01-01 00:00:00"), ("late", "2023-12-31 23:59:59"), ("ahead", "2024-01-05 00:00:00")], "k string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r["k"]: (r["age_seconds"], r["is_stale"]) for r in quality.freshness(df, ["k"], "t", "2024-01-02 00:00:00").collect()}
    assert got == {"at": (86400.0, False), "late": (86401.0, True), "ahead": (0.0, False)}
    with pytest.raises(ValueError):
        quality.freshness(df, ["k"], "t", "2024-01-02", -1)


def test_missing_and_the_text_null_are_two_categories(make):
    a, b = make([(None,)] * 4, "c string"), make([("<null>",)] * 4, "c string")
    assert drift.drift_report(a, b).first()["frequency_distance"] == 2.0
